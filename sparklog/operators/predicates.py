"""Filter settings as ``Column`` predicates.

Settings are a dictionary; absent keys filter nothing, all given ones must hold.  Simple
comparisons come first, so that Parquet gets them and the costly text search runs on what is
left.  An excluded value never drops a row where the column is null.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog.functions.scalars import all_of, any_of, number, text

#: Bits of the audit outcome in the keywords number.
AUDIT_BITS = {"audit success": 53, "audit failure": 52}
#: Level names and numbers.
LEVELS = {"critical": 1, "error": 2, "warning": 3, "information": 4, "verbose": 5, "logalways": 0}
#: Names of logon types.
LOGON_TYPES = {"interactive": "2", "network": "3", "batch": "4", "service": "5", "unlock": "7", "networkcleartext": "8", "newcredentials": "9", "remoteinteractive": "10", "cachedinteractive": "11"}

#: Preset filters by name.
PRESETS = {
    "errors": {"levels": ["error", "critical"]},
    "warnings": {"levels": ["warning"]},
    "critical": {"levels": ["critical"]},
    "information": {"levels": ["information"]},
    "logons": {"ids": [4624]},
    "failed_logons": {"ids": [4625]},
    "processes": {"ids": [1, 4688]},
    "services": {"ids": [7045, 4697]},
    "tasks": {"ids": [4698, 4699, 4700, 4701, 4702]},
    "accounts": {"ids": [4720, 4722, 4723, 4724, 4725, 4726, 4738]},
    "log_clearing": {"ids": [1102, 517, 104]},
    "scripts": {"ids": [4103, 4104]},
}

#: Where the settings find a record's values; a view with other names passes its own.
COLUMNS = {"id": "event_code", "level": "level", "ts": "ts", "computer": "computer", "users": ["user_name"], "sources": ["source_file"], "channel": "source_file", "task": "level", "search": ["record_id", "event_code", "source_file", "computer", "user_name", "ip_address", "process_name", "parent_name"]}


def id_ranges(expression: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[str]]:
    """Included and excluded ranges, and bad tokens, of ``a-b,c!d,e-f``."""
    wanted: list[tuple[int, int]] = []
    unwanted: list[tuple[int, int]] = []
    bad: list[str] = []
    for part, out in zip(expression.split("!", 1), (wanted, unwanted), strict=False):
        for token in filter(None, (t.strip() for t in part.split(","))):
            found = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", token)
            if not found:
                bad.append(token)
                continue
            lo, hi = int(found[1]), int(found[2] or found[1])
            if lo > hi:
                bad.append(token)
            else:
                out.append((lo, hi))
    return wanted, unwanted, bad


def in_ranges(c: Column, expression: str, invert: bool = False) -> Column:
    wanted, unwanted, _ = id_ranges(expression)
    inside = any_of([c.between(lo, hi) for lo, hi in wanted]) if wanted else F.lit(True)
    hit = inside & ~any_of([c.between(lo, hi) for lo, hi in unwanted])
    return ~hit if invert else hit


def audit(keywords: Column, outcome: str) -> Column:
    """Whether a keywords number (text in hexadecimal) has the outcome's bit."""
    digits = F.regexp_replace(F.lower(keywords), "^0x", "")
    return F.coalesce(F.shiftright(F.conv(digits, 16, -10).cast("long"), AUDIT_BITS[outcome]).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def has_level(c: Column, levels: list, keywords: Column | None = None) -> Column:
    """Levels as numbers, numeric texts or names; audit outcomes look at ``keywords``."""
    numbers = {int(x) if str(x).isdigit() else LEVELS[str(x).lower()] for x in levels if str(x).isdigit() or str(x).lower() in LEVELS}
    outcomes = [str(x).lower() for x in levels if str(x).lower() in AUDIT_BITS]
    if numbers >= set(range(6)) and not outcomes:
        return F.lit(True)
    parts = [c.isin(sorted(numbers))] if numbers else []
    if keywords is not None:
        parts += [audit(keywords, x) for x in outcomes]
    return any_of(parts)


def contains_any(columns: list[str], terms: list[str], exclude: bool = False) -> Column:
    """Whether any column holds any term, whatever the case."""
    hit = any_of([F.contains(F.lower(text(c)), F.lit(t.lower())) for c in columns for t in terms])
    return ~hit if exclude else hit


def in_window(ts: Column, spec: dict) -> Column:
    """Modes ``range``, ``date``, ``time`` and ``separate`` with bounds ``from`` and ``to``, in ``zone``, by whole seconds."""
    zone = spec.get("zone", "UTC")
    local = ts if zone == "UTC" else F.from_utc_timestamp(ts.cast("timestamp"), zone)
    local = F.date_trunc("second", local)
    lo, hi = spec.get("from"), spec.get("to")
    mode = spec.get("mode", "range")
    parts = []
    if mode in ("range", "date"):
        kind, cut = ("timestamp_ntz", 19) if mode == "range" else ("date", 10)
        value = local.cast(kind)
        parts += [value >= F.lit(lo[:cut]).cast(kind)] if lo else []
        parts += [value <= F.lit(hi[:cut]).cast(kind)] if hi else []
    elif mode == "time":
        clock = F.date_format(local, "HH:mm:ss")
        if lo and hi and lo > hi:  # over midnight
            parts.append((clock >= lo) | (clock <= hi))
        else:
            parts += [clock >= lo] if lo else []
            parts += [clock <= hi] if hi else []
    else:
        parts += [in_window(ts, {"mode": "date", "from": spec.get("date_from"), "to": spec.get("date_to"), "zone": zone})]
        parts += [in_window(ts, {"mode": "time", "from": spec.get("time_from"), "to": spec.get("time_to"), "zone": zone})]
    hit = all_of(parts)
    return F.coalesce(~hit, F.lit(True)) if spec.get("exclude") else F.coalesce(hit, F.lit(False))


def relative(ts: Column, hours: float, as_of: datetime | None = None, exclude: bool = False) -> Column:
    """The last ``hours`` before ``as_of`` (or now)."""
    end = F.lit(as_of) if as_of else F.current_timestamp()
    hit = ts >= (end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))).cast("timestamp_ntz")
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if exclude else hit


def search_blob(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[text(c) for c in columns])


def search(blob: Column, terms: list[str], mode: str = "AND", regex: bool = False, case: bool = False, exclude: bool = False) -> Column:
    """Terms joined by AND, OR or NOT (none of them); ``exclude`` turns AND and OR around."""
    if not terms:
        return F.lit(True)
    if regex:
        hits = [blob.rlike(t if case else f"(?i){t}") for t in terms]
    else:
        hits = [F.contains(blob if case else F.lower(blob), F.lit(t if case else t.lower())) for t in terms]
    if mode == "NOT":
        return ~any_of(hits)
    hit = all_of(hits) if mode == "AND" else any_of(hits)
    return ~hit if exclude else hit


def synonyms(value: str) -> list[str]:
    """The value in other notations: decimal and hexadecimal with common widths, names of logon types, yes and no."""
    out = {value, value.lower()}
    v = value.strip().lower()
    n = int(v, 16) if re.fullmatch(r"0x[0-9a-f]+", v) else int(v) if v.isdigit() else None
    if n is not None:
        out |= {str(n), hex(n), *(f"0x{n:0{w}x}" for w in (4, 8, 16))}
    if v in LOGON_TYPES:
        out.add(LOGON_TYPES[v])
    out |= {"yes": {"true", "1", "%%1842"}, "no": {"false", "0", "%%1843"}}.get(v, set())
    return sorted(out)


def condition(c: Column, operator: str, value: str, expand: bool = False) -> Column:
    """One of nine comparisons of a field with a value, whatever the case; unknown ones match nothing."""
    own = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    values = synonyms(value) if expand else [value]
    low = [v.lower() for v in values]
    hits = {
        "contains": lambda: any_of([F.contains(own, F.lit(v)) for v in low]),
        "equals": lambda: own.isin(low),
        "starts with": lambda: any_of([own.startswith(v) for v in low]),
        "ends with": lambda: any_of([own.endswith(v) for v in low]),
        "not contains": lambda: ~any_of([F.contains(own, F.lit(v)) for v in low]),
        "not equals": lambda: ~own.isin(low),
        "regex": lambda: own.rlike(f"(?i){value}"),
        "greater than": lambda: F.coalesce(number(own).cast("double"), own.try_cast("double")) > float(value),
        "less than": lambda: F.coalesce(number(own).cast("double"), own.try_cast("double")) < float(value),
    }
    hit = hits.get(operator.lower(), lambda: F.lit(False))()
    return F.coalesce(hit, F.lit(False))


def dual_condition(columns: list[Column], operator: str, value: str, expand: bool = False) -> Column:
    """A field with two sources: any may match, but for negative operators all must."""
    hits = [condition(c, operator, value, expand) for c in columns]
    return all_of(hits) if operator.lower().startswith("not ") else any_of(hits)


def quick_filter(includes: dict[str, list], excludes: dict[str, list]) -> Column:
    """Values of columns to keep, and to leave out (rows without a value stay)."""
    parts = [F.col(c).isin(values) for c, values in includes.items() if values]
    parts += [F.col(c).isNull() | ~F.col(c).isin(values) for c, values in excludes.items() if values]
    return all_of(parts)


def rule(selection: dict, exclude: list[dict] = ()) -> Column:
    """Detection rule: all of ``selection`` and none of the ``exclude`` groups (each all of its own).

    Keys are ``column`` or ``column|how`` with how one of contains, startswith, endswith, and
    ``_any`` appended for lists; nothing looks at the case.
    """

    def one(key: str, value: object) -> Column:
        name, _, how = key.partition("|")
        own = F.lower(text(name))
        values = [str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]
        how = how.removesuffix("_any")
        tests = {"": lambda v: own == v, "contains": lambda v: F.contains(own, F.lit(v)), "startswith": lambda v: own.startswith(v), "endswith": lambda v: own.endswith(v)}
        return any_of([tests[how](v) for v in values])

    hit = all_of([one(k, v) for k, v in selection.items()])
    for group in exclude:
        hit = hit & ~all_of([one(k, v) for k, v in group.items()])
    return hit


def rule_sql(selection: dict) -> str:
    """The conditions of a ``rule``'s selection as SQL text, which is much faster to build than columns where there are many rules."""
    quoted = lambda v: "'" + str(v).lower().replace("\\", "\\\\").replace("'", "\\'") + "'"
    tests = {"": "{own} = {v}", "contains": "contains({own}, {v})", "startswith": "startswith({own}, {v})", "endswith": "endswith({own}, {v})"}
    out = []
    for key, value in selection.items():
        name, _, how = key.partition("|")
        values = value if isinstance(value, (list, tuple)) else [value]
        own = f"lower(coalesce(cast({name} as string), ''))"
        out.append("(" + " or ".join(tests[how.removesuffix("_any")].format(own=own, v=quoted(v)) for v in values) + ")")
    return " and ".join(out) or "true"


def filter_predicate(fc: dict, columns: dict | None = None) -> Column:
    """All settings of ``fc`` together."""
    at = COLUMNS | (columns or {})
    col = lambda k: F.col(at[k])
    parts: list[Column] = []
    if fc.get("ids"):
        parts.append(col("id").isin(fc["ids"]))
    if fc.get("exclude_ids"):
        parts.append(~F.coalesce(col("id").isin(fc["exclude_ids"]), F.lit(False)))
    if fc.get("id_expression"):
        parts.append(in_ranges(col("id"), fc["id_expression"], fc.get("id_invert", False)))
    if fc.get("levels"):
        parts.append(has_level(col("level"), fc["levels"], col("keywords") if "keywords" in at else None))
    if fc.get("tasks"):
        parts.append(col("task").isin(fc["tasks"]))
    if fc.get("window"):
        parts.append(in_window(col("ts"), fc["window"]))
    if fc.get("relative"):
        parts.append(relative(col("ts"), **fc["relative"]))
    for key, where in (("sources", at["sources"]), ("channels", [at["channel"]]), ("users", at["users"]), ("computers", [at["computer"]])):
        if fc.get(key):
            parts.append(contains_any(where, fc[key], fc.get(f"exclude_{key}", False)))
    for c in fc.get("conditions", []):
        parts.append(condition(F.col(c["field"]), c["operator"], c["value"], c.get("expand", False)))
    if fc.get("search"):
        parts.append(search(search_blob(at["search"]), **fc["search"]))
    return all_of(parts)


def merged(base: dict, extra: dict) -> dict:
    """``extra`` over ``base``: lists are united, other settings replaced."""
    out = dict(base)
    for k, v in extra.items():
        out[k] = [*out[k], *(x for x in v if x not in out[k])] if isinstance(v, list) and isinstance(out.get(k), list) else v
    return out


def profile_filter(base: dict, profiles: list[dict]) -> dict:
    """Profiles united; their ids are cut down to the base's ids if it has any."""
    out: dict = {}
    for p in profiles:
        out = merged(out, {{"event_ids": "ids"}.get(k, k): v for k, v in p.items() if k in ("event_ids", "sources", "channels", "computers", "users", "levels", "conditions") and v})
    if base.get("ids") and out.get("ids"):
        out["ids"] = [x for x in out["ids"] if x in base["ids"]]
    return {**out, **{k: v for k, v in base.items() if k != "ids" or not out.get("ids")}}
