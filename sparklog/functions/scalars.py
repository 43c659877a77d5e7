"""Column functions of log analysis; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def basename(path: Column) -> Column:
    """Last part of a Windows or POSIX path, lower-cased."""
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def let(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a column that is computed once, however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(c), of), 1)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty text."""
    n = F.length(c).cast("double")
    counts = F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))), lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def near_name(c: Column, names: list[str], most: int = 2) -> Column:
    """The first of ``names`` within ``most`` edits, but not equal; null if none is."""
    found = [F.when((c != n) & (F.abs(F.length(c) - len(n)) <= most) & F.levenshtein(c, F.lit(n), most).between(1, most), F.lit(n)) for n in names]
    return F.coalesce(*found)


def consonant_ratio(c: Column) -> Column:
    letters = F.length(F.regexp_replace(F.lower(c), "[^a-z]", ""))
    consonants = F.length(F.regexp_replace(F.lower(c), "[^bcdfghjklmnpqrstvwxyz]", ""))
    return F.when(letters > 0, consonants / letters).otherwise(0.0)


def digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^0-9]", "")) / F.length(c)).otherwise(0.0)


def number(c: Column) -> Column:
    """Decimal, or hexadecimal with its prefix; null if neither."""
    c = F.trim(c)
    hexadecimal = F.when(c.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(c, 3, 16), 16, 10).try_cast("decimal(20,0)").try_cast("long"))
    return F.coalesce(hexadecimal, c.try_cast("long"))


def hex_normal(c: Column) -> Column:
    """Lower-case hexadecimal with prefix and no leading zeros, of a prefixed, bare (over 3 digits) or decimal number."""
    c = F.lower(F.trim(c))
    digits = F.when(c.startswith("0x"), F.substring(c, 3, 64)).when(c.rlike("^[0-9]+$"), F.lower(F.hex(c.try_cast("long")))).when(c.rlike("^[0-9a-f]{4,}$"), c)
    trimmed = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits.rlike("^[0-9a-f]+$"), F.concat(F.lit("0x"), trimmed))


def bit_labels(value: Column, labels: dict[int, str]) -> Column:
    """Labels of the set bits, by ascending bit."""
    table = F.array(*[F.struct(F.lit(bit).cast("long").alias("bit"), F.lit(name).alias("name")) for bit, name in sorted(labels.items())])
    return F.transform(F.filter(table, lambda x: value.cast("long").bitwiseAND(x["bit"]) != 0), lambda x: x["name"])


def decode_encoded_command(c: Column) -> Column:
    """Text of a base64 command in UTF-16LE; null if it isn't one."""
    payload = F.regexp_extract(c, r"(?i)-e(?:nc(?:odedcommand)?|c)?\s+([A-Za-z0-9+/=]{8,})", 1)
    return F.when(payload != "", F.decode(F.try_to_binary(payload, F.lit("base64")), "UTF-16LE"))


def key_values(c: Column) -> Column:
    """Lines of ``key = value`` as a map, both trimmed; the last of equal keys counts."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains("="))
    blank = F.lit(" \t\r\x0b\x0c")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1), blank).alias("col1"), F.trim(F.regexp_replace(x, "^[^=]*=", ""), blank).alias("col2")))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["col1"]), F.map_from_arrays(F.array(p["col1"]), F.array(p["col2"]))))


def duration(seconds: Column) -> Column:
    """HH:MM:SS; negative durations are zero."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def squeeze(c: Column, most: int | None = 500) -> Column:
    """Control characters and runs of white space become one blank, cut at ``most`` characters where given."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), " +", " "))
    return out if most is None else F.left(out, F.lit(most))


#: Fixed value: characters that XML can't hold.
_NOT_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]"


def xml_text(c: Column) -> Column:
    """Text that XML may hold: markup characters escaped, characters that it can't hold shown as ``\\xNN``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    code = lambda x: F.hex(F.ascii(x))
    shown = lambda x: F.when(x.rlike(_NOT_XML), F.concat(F.lit("\\x"), F.when(F.length(code(x)) < 2, "0").otherwise(""), code(x))).otherwise(x)
    return F.when(c.rlike(_NOT_XML), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), shown), "")).otherwise(c)


def stix_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def masked_command(c: Column) -> Column:
    """Template of a command line: ids, user folders, addresses, versions, random tokens and base64 become marks."""
    c = F.regexp_replace(c, r"(?i)\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?", "<GUID>")
    c = F.regexp_replace(c, r"(?i)([a-z]:\\users\\)[^\\ ]+", "$1<USER>")
    c = F.regexp_replace(c, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>")
    c = F.regexp_replace(c, r"\b\d+(\.\d+){1,3}\b", "<VER>")

    def mask(token: Column) -> Column:
        noisy = (F.length(token) >= 8) & (entropy(token) > 4.8)
        return F.when(noisy & token.rlike("^[0-9a-fA-F]+$"), "<HEX>").when(noisy, "<ENC>").otherwise(token)

    c = F.array_join(F.transform(F.split(c, " "), mask), " ")
    c = F.regexp_replace(c, r"[A-Za-z0-9+/]{40,}={0,2}", "<B64>")
    return F.lower(c)


def system_account(user: Column) -> Column:
    """Built-in accounts, machine accounts and window-manager accounts."""
    u = F.upper(F.coalesce(user, F.lit("")))
    return u.isin("", "-", "SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS LOGON") | u.endswith("$") | u.startswith("DWM-") | u.startswith("UMFD-")


#: Accounts of the system and its services.
BUILTIN = ["system", "local service", "network service", "anonymous logon", "iusr", "network", "local system", "defaultaccount", "wdagutilityaccount"]


def builtin_account(user: Column) -> Column:
    """Accounts of the system, its services and of machines; a blank isn't one."""
    u = F.lower(F.trim(F.coalesce(user, F.lit(""))))
    return u.isin(BUILTIN) | u.startswith("nt authority\\") | u.startswith("nt service\\") | u.endswith("$")


#: Folders that programs of services are in, and parts of folders that they shouldn't be in.
SERVICE_FOLDERS = ["c:/windows/", "c:/program files/", "c:/program files (x86)/"]
ODD_SERVICE_FOLDERS = ["/temp/", "/tmp/", "/appdata/", "/programdata/", "/users/", "/desktop/", "/downloads/", "/recycle"]


def service_path_is_odd(path: Column) -> Column:
    """Whether a service's program lies in a folder that users can write to; false for a blank."""
    p = F.lower(F.coalesce(path, F.lit("")))
    p = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r'^"+|"+$', "")
    for name, value in (("%systemroot%", "c:/windows"), ("%windir%", "c:/windows"), ("%programfiles%", "c:/program files")):
        p = F.replace(p, F.lit(name), F.lit(value))
    return ~any_of([p.startswith(x) for x in SERVICE_FOLDERS]) & any_of([F.contains(p, F.lit(x)) for x in ODD_SERVICE_FOLDERS])


def picked_user(*candidates: Column) -> Column:
    """The first that isn't blank or a dash, lower-cased."""
    return F.lower(F.coalesce(*[F.when(~F.trim(c).isin("", "-"), F.trim(c)) for c in candidates], F.lit("")))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def jsd_term(p: Column, q: Column) -> Column:
    """One key's part of a Jensen-Shannon divergence in bits, where ``p`` is over 0."""
    return 0.5 * (p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0))
