"""Readable forms of codes, and short texts of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.scalars import bit_labels, hex_normal

#: Logon types.
LOGON_TYPE = {"2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive", "11": "CachedInteractive"}
#: Status codes of failed logons.
STATUS = {"0xc0000064": "no such user", "0xc000006a": "wrong password", "0xc000006d": "bad name or password", "0xc0000070": "workstation not allowed", "0xc0000071": "password expired", "0xc0000072": "account disabled", "0xc0000193": "account expired", "0xc0000234": "account locked"}
#: Bits of an access mask.
ACCESS = {0x1: "ReadData", 0x2: "WriteData", 0x4: "AppendData", 0x8: "ReadEA", 0x10: "WriteEA", 0x20: "Execute", 0x40: "DeleteChild", 0x80: "ReadAttributes", 0x100: "WriteAttributes", 0x10000: "Delete", 0x20000: "ReadControl", 0x40000: "WriteDac", 0x80000: "WriteOwner", 0x100000: "Synchronize"}
#: Well-known security ids.
SIDS = {"S-1-0-0": "Nobody", "S-1-1-0": "Everyone", "S-1-5-18": "System", "S-1-5-19": "Local Service", "S-1-5-20": "Network Service", "S-1-5-32-544": "Administrators"}

#: Our own short texts; %1 user, %2 computer, %3 process, %4 address.
TEXTS = {4624: "%1 logged on to %2 from %4", 4625: "Logon of %1 to %2 from %4 failed", 4672: "%1 got special rights on %2", 4688: "%1 started %3 on %2", 4720: "Account %1 was made on %2", 4698: "A task was made on %2", 1102: "The security log of %2 was cleared"}


def decoded(code: Column, table: dict[str, str]) -> Column:
    """Text of a code; unknown codes stay as they are."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(names[F.lower(code) if next(iter(table)).startswith("0x") else code], code)


def status_text(code: Column) -> Column:
    return decoded(hex_normal(code), STATUS)


def access_text(mask: Column) -> Column:
    return F.array_join(bit_labels(mask, ACCESS), ", ")


def described(df: DataFrame, code: str, user: Column, computer: Column, process: Column, address: Column) -> DataFrame:
    """``df`` with a short text per event, by a broadcast dimension of templates."""
    dim = df.sparkSession.createDataFrame(list(TEXTS.items()), f"{code} int, template string")
    text = F.coalesce("template", F.concat(F.lit("Event "), F.col(code).cast("string")))
    for mark, value in (("%1", user), ("%2", computer), ("%3", process), ("%4", address)):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("?")))
    return df.join(F.broadcast(dim), code, "left").withColumn("description", text).drop("template")
