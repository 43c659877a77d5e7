"""Attack chains over a log of events with their payload fields as columns.

Every rule takes a log with ``record_id`` and ``source_file`` (together the event's key; logs of one file may do
without the latter), ``sec`` (time in whole seconds), ``event_code``, ``computer`` and the fields that it looks at.
``rule.members(log)`` has one row per event of a chain; ``rule(log)`` one per chain: rule, severity, computer,
user_name, first_event (the event that the chain begins with), hosts (sorted), first_s, last_s, n (all its events),
and shown (keys of those a report lists).  Only ``shown`` is short; no chain and no member is left out.

The acting user is the subject, else the target, lower-cased; rules of logons skip built-in accounts.  Effects never
come before their cause; events of one second count as in order.  Logon ids and GUIDs are joined within a host.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.functions.scalars import any_of, basename, builtin_account, picked_user, service_path_is_odd
from sparklog.operators.ioc import LOLBAS, ODD_PATHS
from sparklog.operators.sequences import burst_rows, bursts, interval_join, window_groups, window_summary
from sparklog.sources.files import stored

#: Sub-states of a failed logon that mean a wrong password.
WRONG_PASSWORD = ["0xc000006a", "0xc000006d", "0xc0000022"]
#: Addresses that aren't of another machine.
LOCAL_ADDRESSES = ["", "-", "127.0.0.1", "::1", "::ffff:127.0.0.1"]
#: Privileges that give control of the system.
DANGEROUS_PRIVILEGES = ["SeTcbPrivilege", "SeDebugPrivilege", "SeImpersonatePrivilege", "SeAssignPrimaryTokenPrivilege", "SeLoadDriverPrivilege", "SeRestorePrivilege", "SeTakeOwnershipPrivilege"]
#: Weak ticket ciphers, and services whose tickets are of no interest.
WEAK_CIPHERS = ["0x17", "23", "rc4"]
TICKET_NOISE = ["", "krbtgt", "krbtgt/", "kadmin/changepw"]
#: Parents of a shell that call for a look.
ODD_SHELL_PARENTS = ["wmiprvse", "wscript", "mshta", "svchost", "dllhost", "winword", "excel", "outlook", "msiexec"]
#: Helpers that the system starts by itself.
HELPERS = ["conhost.exe", "dllhost.exe", "svchost.exe", "taskhost.exe", "taskhostw.exe", "backgroundtaskhost.exe", "runtimebroker.exe", "wermgr.exe", "werfault.exe", "msiexec.exe", "sihost.exe", "ctfmon.exe", "fontdrvhost.exe", "dwm.exe", "winlogon.exe"]
#: Programs of documents and browsers, and children that they shouldn't have.
ODD_SPAWNS = {
    "winword.exe": ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe", "wmic.exe"],
    "excel.exe": ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe", "wmic.exe"],
    "powerpnt.exe": ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe"],
    "outlook.exe": ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe"],
    "iexplore.exe": ["cmd.exe", "powershell.exe", "mshta.exe", "wscript.exe", "cscript.exe"],
    "msedge.exe": ["cmd.exe", "powershell.exe", "mshta.exe"],
    "chrome.exe": ["cmd.exe", "powershell.exe", "mshta.exe"],
    "acrord32.exe": ["cmd.exe", "powershell.exe", "wscript.exe"],
    "acrobat.exe": ["cmd.exe", "powershell.exe", "wscript.exe"],
    "mshta.exe": ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe"],
    "wscript.exe": ["cmd.exe", "powershell.exe", "mshta.exe"],
    "cscript.exe": ["cmd.exe", "powershell.exe", "mshta.exe"],
}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
#: Fixed value: the GUID of no process.
NO_GUID = "{00000000-0000-0000-0000-000000000000}"


def with_event(log: DataFrame) -> DataFrame:
    """``log`` with ``event``, the key of each row: its number, and the file that the number counts in."""
    file = F.col("source_file") if "source_file" in log.columns else F.lit("")
    return log.withColumn("event", F.struct("record_id", file.alias("source_file")))


def acting(log: DataFrame) -> DataFrame:
    """``log`` with ``event`` and ``user_name``, the acting user of each event."""
    return with_event(log).withColumn("user_name", picked_user(F.col("subject_user"), F.col("target_user")))


def _person() -> Column:
    return (F.col("user_name") != "") & ~builtin_account(F.col("user_name"))


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _code(*codes: int) -> Column:
    return F.col("event_code").isin(list(codes))


@dataclass
class Rule:
    """``find`` gives the members: chain (key of the first event), computer, user_name, event, sec, host, lead (whether it is
    the first event), listed (whether a report may show it), and severity where it differs by chain.

    A chain shows its first event and the ``most`` first of the others, or before it the ``most`` last ones.
    """

    find: Callable[..., DataFrame]
    severity: str
    most: int
    last: bool = False

    def __post_init__(self) -> None:
        self.__name__, self.__doc__ = self.find.__name__, self.find.__doc__

    def members(self, log: DataFrame, **parameters) -> DataFrame:
        found = self.find(log, **parameters)
        return found if "severity" in found.columns else found.withColumn("severity", F.lit(self.severity))

    def __call__(self, log: DataFrame, **parameters) -> DataFrame:
        members = self.members(log, **parameters)
        key = ["chain", "severity", "computer", "user_name"]
        chains = members.groupBy(*key).agg(F.min("sec").alias("first_s"), F.max("sec").alias("last_s"), F.count("*").alias("n"), F.sort_array(F.collect_set(F.when(F.col("host") != "", F.col("host")))).alias("hosts"))
        order = [F.col("sec"), F.col("event")]
        place = F.row_number().over(W.partitionBy("chain").orderBy(*[c.desc() if self.last else c.asc() for c in order]))
        # ranks up to a number are cut before the shuffle, so that a chain of many events costs a few rows of each task
        top = members.where(F.col("listed") & ~F.col("lead")).select("chain", *order, place.alias("_p")).where(F.col("_p") <= self.most)
        ids = top.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("sec", "event")))["event"].alias("ids"))
        own, others = F.array("chain"), F.coalesce("ids", F.array().cast("array<struct<record_id:bigint,source_file:string>>"))
        shown = F.concat(others, own) if self.last else F.concat(own, others)
        return chains.join(ids, "chain", "left").select(F.lit(self.__name__).alias("rule"), "severity", "computer", "user_name", F.col("chain").alias("first_event"), "hosts", "first_s", "last_s", "n", shown.alias("shown"))


def rule(severity: str, most: int, last: bool = False) -> Callable[[Callable[..., DataFrame]], Rule]:
    return lambda find: Rule(find, severity, most, last)


def _burst_members(rows: DataFrame, found: DataFrame, keys: list[str], seconds: int, computer: Column, user: Column) -> DataFrame:
    """Rows of bursts (keys, sec, event, host) as members."""
    of = burst_rows(rows, found, keys, seconds)
    return of.select(F.col("l_first_id").alias("chain"), computer.alias("computer"), user.alias("user_name"), F.col("r_event").alias("event"), F.col("r_sec").alias("sec"), F.col("r_host").alias("host"), (F.col("r_event") == F.col("l_first_id")).alias("lead"), F.lit(True).alias("listed"))


@dataclass
class Pairs:
    """Events ``leads``, each with the ``others`` of its ``keys`` in the ``seconds`` from it on (``back``: strictly before it).

    Where ``preferred`` holds for some of a lead's others, only those count.
    """

    leads: DataFrame
    others: DataFrame
    keys: list[str]
    seconds: int
    back: bool = False
    preferred: Column | None = None

    def seen(self, most: int) -> DataFrame:
        """Leads with others, and of these the number n, far_s, the top ``most``, and whether they are preferred ones."""
        of = lambda others: window_summary(self.leads, others, self.keys, self.seconds, most, back=self.back, strict=self.back)
        found = of(self.others).withColumn("only", F.lit(False))
        if self.preferred is not None:
            both = found.unionByName(of(self.others.where(self.preferred)).withColumn("only", F.lit(True)))
            best = both.groupBy(*self.keys, "sec").agg(F.max_by(F.struct("n", "far_s", "top", "only"), "only").alias("best"))
            found = best.select(*self.keys, "sec", "best.*")
        return self.leads.join(found, [*self.keys, "sec"])

    def members(self) -> DataFrame:
        leads = self.seen(1).select(*self.leads.columns, "only")
        others = self.others.withColumn("good", F.lit(True) if self.preferred is None else F.coalesce(self.preferred, F.lit(False)))
        row = lambda event, sec, is_lead: [event.alias("event"), sec.alias("sec"), F.col("computer").alias("host"), F.lit(is_lead).alias("lead"), F.lit(True).alias("listed")]
        chain = [F.col("event").alias("chain"), F.col("computer"), F.col("user_name")]
        groups = window_groups(leads, others, self.keys, self.seconds, ["good"], back=self.back, strict=self.back)
        pairs = groups.where(F.col("good") | ~F.col("only")).select("event", "computer", "user_name", F.col("other_s"), F.explode("others").alias("other"))
        return pairs.select(*chain, *row(F.col("other"), F.col("other_s"), False)).union(leads.select(*chain, *row(F.col("event"), F.col("sec"), True)))


class PairRule(Rule):
    """A rule whose ``find`` gives ``Pairs`` that have no lead in common.

    Chains are made of what windows of time hold, so that they cost no row per member; ``members`` does.
    """

    def members(self, log: DataFrame, **parameters) -> DataFrame:
        return reduce(DataFrame.union, [p.members() for p in self.find(log, **parameters)]).withColumn("severity", F.lit(self.severity))

    def __call__(self, log: DataFrame, **parameters) -> DataFrame:
        return reduce(DataFrame.union, [self._chains(p) for p in self.find(log, **parameters)])

    def _chains(self, p: Pairs) -> DataFrame:
        own, ids = F.array("event"), F.col("top.event")
        first, last = (F.col("far_s"), F.col("sec")) if p.back else (F.col("sec"), F.col("far_s"))
        hosts = F.when(F.col("computer") != "", F.array("computer")).otherwise(F.array().cast("array<string>"))
        shown = F.concat(F.reverse(ids), own) if p.back else F.concat(own, ids)
        return p.seen(self.most).select(F.lit(self.__name__).alias("rule"), F.lit(self.severity).alias("severity"), "computer", "user_name", F.col("event").alias("first_event"), hosts.alias("hosts"), first.alias("first_s"), last.alias("last_s"), (F.col("n") + 1).alias("n"), shown.alias("shown"))


def pair_rule(severity: str, most: int, last: bool = False) -> Callable[[Callable[..., list[Pairs]]], PairRule]:
    return lambda find: PairRule(find, severity, most, last)


@rule("high", 10)
def brute_force(log: DataFrame, least: int = 5, seconds: int = 300, success_within: int = 120) -> DataFrame:
    """Failures of a user on a host, and a success soon after the last of them, which ends the chain."""
    rows = acting(log).where(_code(4624, 4625) & _person()).select("computer", "user_name", "sec", "event", "event_code", "sub_status", F.col("computer").alias("host"))
    state = F.lower(_text("sub_status"))
    failed = rows.where(_code(4625) & ((state == "") | state.isin(WRONG_PASSWORD))).drop("event_code", "sub_status")
    wins = rows.where(_code(4624)).select("computer", "user_name", "sec", "event")
    keys = ["computer", "user_name"]

    def with_success(starts: DataFrame) -> DataFrame:
        pairs = interval_join(starts, wins, keys, success_within, left_s="end_s")
        columns = [F.col(f"l_{c}").alias(c) for c in starts.columns]
        return pairs.groupBy(*columns).agg(F.min(F.struct(F.col("r_sec").alias("sec"), F.col("r_event").alias("event"))).alias("success"))

    found = bursts(failed, keys, seconds, least, tie="event", refine=with_success)
    failures = _burst_members(failed, found, keys, seconds, F.col("l_computer"), F.col("l_user_name"))
    ends = found.select(F.col("first_id").alias("chain"), "computer", "user_name", F.col("success.event").alias("event"), F.col("success.sec").alias("sec"), F.col("computer").alias("host"), F.lit(False).alias("lead"), F.lit(True).alias("listed"))
    return failures.union(ends)


@pair_rule("high", 3)
def service_after_logon(log: DataFrame, seconds: int = 120) -> list[Pairs]:
    """A service installed soon after a logon over the network; services of odd paths are preferred."""
    rows = acting(log).select("event", "sec", "computer", "user_name", "event_code", "logon_type", "ip_address", "service_path")
    logons = rows.where(_code(4624) & (_text("logon_type") == "3") & ~_text("ip_address").isin(LOCAL_ADDRESSES))
    return [Pairs(logons, rows.where(_code(7045, 4697)), ["computer"], seconds, preferred=service_path_is_odd(F.col("service_path")))]


def _dangerous() -> Column:
    return any_of([F.contains(_text("privileges"), F.lit(p)) for p in DANGEROUS_PRIVILEGES])


@pair_rule("high", 2)
def privilege_after_logon(log: DataFrame, seconds: int = 30) -> list[Pairs]:
    """Dangerous privileges of the same user soon after a logon; not among ``all_chains``."""
    rows = acting(log).where(_person()).select("event", "sec", "computer", "user_name", "event_code", "logon_type", "privileges")
    logons = rows.where(_code(4624) & ~_text("logon_type").isin("4", "5"))
    return [Pairs(logons, rows.where(_code(4672) & _dangerous()), ["computer", "user_name"], seconds)]


@rule("high", 10)
def weak_tickets(log: DataFrame, least: int = 3, seconds: int = 300) -> DataFrame:
    """Service tickets of a weak cipher on one host, but for machines' and the ticket service's own."""
    service = _text("ticket_service")
    rows = acting(log).where(_code(4769) & F.lower(_text("ticket_cipher")).isin(WEAK_CIPHERS) & ~builtin_account(F.col("user_name")) & ~service.endswith("$") & ~F.lower(service).isin(TICKET_NOISE))
    rows = rows.select("computer", "sec", "event", F.col("computer").alias("host"))
    return _burst_members(rows, bursts(rows, ["computer"], seconds, least, tie="event"), ["computer"], seconds, F.col("l_computer"), F.lit(""))


@rule("high", 0)
def pass_the_hash(log: DataFrame) -> DataFrame:
    """Network logons by NTLM from another machine without a session key."""
    package = F.lower(_text("lm_package"))
    rows = acting(log).where(_code(4624) & (_text("logon_type") == "3") & F.contains(F.lower(_text("auth_package")), F.lit("ntlm")) & _person() & ~_text("ip_address").isin(LOCAL_ADDRESSES) & _text("key_length").isin("", "0") & ((package == "") | F.contains(package, F.lit("ntlm"))))
    return rows.select(F.col("event").alias("chain"), "computer", "user_name", "event", "sec", F.col("computer").alias("host"), F.lit(True).alias("lead"), F.lit(True).alias("listed"))


@pair_rule("critical", 5, last=True)
def log_clearing(log: DataFrame, seconds: int = 1800) -> list[Pairs]:
    """The security log cleared or its policy changed after security events of the host."""
    channel = F.lower(_text("channel"))
    rows = acting(log).where(channel.isin("security", "microsoft-windows-security-auditing")).select("event", "sec", "computer", "user_name", "event_code")
    cleared = _code(1102, 517, 4719)
    return [Pairs(rows.where(cleared), rows.where(~cleared), ["computer"], seconds, back=True)]


@pair_rule("medium", 2)
def task_after_logon(log: DataFrame, seconds: int = 300) -> list[Pairs]:
    """A scheduled task made or changed soon after a logon that isn't a batch's or a service's."""
    rows = acting(log).select("event", "sec", "computer", "user_name", "event_code", "logon_type")
    logons = rows.where(_code(4624) & _person() & ~_text("logon_type").isin("4", "5"))
    return [Pairs(logons, rows.where(_code(4698, 4702)), ["computer"], seconds)]


@pair_rule("medium", 2)
def account_after_recon(log: DataFrame, seconds: int = 600) -> list[Pairs]:
    """An account made soon after groups were listed, by the same user where that one is known."""
    rows = acting(log).select("event", "sec", "computer", "user_name", "event_code")
    listed, made = rows.where(_code(4798, 4799)), rows.where(_code(4720))
    known = F.col("user_name") != ""
    return [Pairs(listed.where(known), made, ["computer", "user_name"], seconds), Pairs(listed.where(~known), made, ["computer"], seconds)]


@rule("high", 9)
def password_spray(log: DataFrame, least: int = 20, seconds: int = 60, users: int = 5) -> DataFrame:
    """Many failures of many users on a host, but for those at its console."""
    rows = acting(log).where(_code(4625) & (_text("logon_type") != "2") & ~builtin_account(F.col("user_name")))
    rows = rows.select("computer", "sec", "event", "user_name", F.col("computer").alias("host"))
    found = bursts(rows, ["computer"], seconds, least, tie="event", distinct="user_name", least_distinct=users)
    return _burst_members(rows, found, ["computer"], seconds, F.col("l_computer"), F.lit(""))


@pair_rule("high", 2)
def script_after_shell(log: DataFrame, seconds: int = 60) -> list[Pairs]:
    """A script block soon after a shell of an odd parent."""
    image, parent = F.lower(_text("image")), F.lower(_text("parent_image"))
    rows = acting(log)
    shells = rows.where(_code(4688) & any_of([F.contains(image, F.lit(x)) for x in ("powershell", "cmd")]) & any_of([F.contains(parent, F.lit(x)) for x in ODD_SHELL_PARENTS]))
    cols = ["event", "sec", "computer", "user_name"]
    return [Pairs(shells.select(*cols), rows.where(_code(4104)).select(*cols), ["computer"], seconds)]


def _sessions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (computer, logon_id) the latest logon, and all else of the id."""
    rows = acting(log).where(_text("logon_id") != "").withColumn("logon_id", F.lower(_text("logon_id")))
    at = F.struct("sec", "event", "user_name", "logon_type")
    return rows.where(_code(4624)).groupBy("computer", "logon_id").agg(F.max(at).alias("logon")), rows


def _session_members(logons: DataFrame, others: DataFrame) -> DataFrame:
    """One chain per session with an event that ``counts``; others of the session belong to it, but aren't listed."""
    key = ["computer", "logon_id"]
    logons = logons.join(others.where("counts").select(*key).distinct(), key, "left_semi")
    row = lambda event, sec, lead, listed: F.struct(event.alias("event"), sec.alias("sec"), F.col("computer").alias("host"), F.lit(lead).alias("lead"), listed.alias("listed"))
    chain = [F.col("logon.event").alias("chain"), F.col("computer"), F.col("logon.user_name").alias("user_name")]
    of = others.join(logons, key).select(*chain, row(F.col("event"), F.col("sec"), False, F.col("counts")).alias("m"))
    leads = logons.select(*chain, row(F.col("logon.event"), F.col("logon.sec"), True, F.lit(True)).alias("m"))
    return of.union(leads).select("chain", "computer", "user_name", "m.*")


@rule("high", 2)
def session_privileges(log: DataFrame) -> DataFrame:
    """Dangerous privileges of a logon's own id."""
    logons, rows = _sessions(log)
    user = F.col("logon.user_name")
    logons = logons.where((user != "") & ~builtin_account(user) & ~F.trim(F.coalesce("logon.logon_type", F.lit(""))).isin("4", "5"))
    others = rows.where(_code(4672) & _dangerous()).select("computer", "logon_id", "event", "sec", F.lit(True).alias("counts"))
    return _session_members(logons, others)


@rule("medium", 3)
def session_processes(log: DataFrame) -> DataFrame:
    """Processes of a network logon's own id, one at least not a helper of the system."""
    logons, rows = _sessions(log)
    user = F.col("logon.user_name")
    logons = logons.where((user != "") & ~builtin_account(user) & (F.trim("logon.logon_type") == "3"))
    name = basename(_text("image"))
    others = rows.where(_code(4688)).select("computer", "logon_id", "event", "sec", ((name != "") & ~name.isin(HELPERS)).alias("counts"))
    return _session_members(logons, others)


@rule("high", 9)
def many_hosts(log: DataFrame, hosts: int = 3, seconds: int = 1800) -> DataFrame:
    """Remote logons of a user on several hosts."""
    rows = acting(log).where(_code(4624) & _text("logon_type").isin("3", "8", "9", "10") & _person())
    rows = rows.select("user_name", "sec", "event", F.col("computer").alias("host"))
    named = rows.withColumn("named", F.when(F.col("host") != "", F.col("host")))
    found = bursts(named, ["user_name"], seconds, 1, tie="event", distinct="named", least_distinct=hosts)
    return _burst_members(rows, found, ["user_name"], seconds, F.lit(""), F.col("l_user_name"))


def _spawn_weight(root: Column, child: Column, image: Column) -> Column:
    """4 for a document's or browser's shell, 3 for a system tool, 2 for an odd folder, else 0."""
    shell = any_of([(root == r) & child.isin(kids) for r, kids in ODD_SPAWNS.items()])
    tool = child.isin([f"{x}.exe" for x in LOLBAS])
    folder = any_of([F.contains(F.replace(image, F.lit("/"), F.lit("\\")), F.lit(p)) for p in ODD_PATHS])
    return F.when(shell, 4).when(tool, 3).when(folder, 2).otherwise(0)


@rule("medium", 19)
def process_trees(log: DataFrame, depth: int = 5) -> DataFrame:
    """Trees of processes by GUID: a document's or browser's shell is critical, a system tool among the descendants high, an odd folder medium.

    Of equal GUIDs the first process has it and its children; every process is a child of its parent's GUID.  A process
    below the root of another tree with a finding isn't a root itself.  From the children that may be a finding their
    ancestors are looked up, level by level; only trees with a finding are then walked down.
    """
    guid = lambda c: F.lower(_text(c))
    rows = acting(log).where(_code(1, 4688) & ~guid("process_guid").isin("", NO_GUID))
    rows = rows.select("computer", "event", "sec", "user_name", guid("process_guid").alias("guid"), guid("parent_guid").alias("parent"), F.lower(_text("image")).alias("image")).withColumn("base", basename(F.col("image")))
    first = rows.groupBy("computer", "guid").agg(F.min(F.struct("sec", "event", "user_name", "base", "parent")).alias("p"))
    roots = first.select("computer", "guid", "p.*")
    edges = rows.where(~F.col("parent").isin("", NO_GUID) & (F.col("parent") != F.col("guid")))
    shells = sorted({k for kids in ODD_SPAWNS.values() for k in kids})
    plain = _spawn_weight(F.lit(""), F.col("base"), F.col("image"))
    level = edges.where((plain > 0) | F.col("base").isin(shells)).select("computer", F.col("parent").alias("at"), "base", "image", F.col("guid").alias("below")).distinct()
    found = None
    for d in range(depth):
        up = level.join(roots.select("computer", F.col("guid").alias("at"), F.col("base").alias("root_base"), F.col("parent").alias("next")), ["computer", "at"])
        hits = up.where("at <> below").select("computer", F.col("at").alias("root"), _spawn_weight(F.col("root_base"), F.col("base"), F.col("image")).alias("w")).where("w > 0")
        found = hits if found is None else found.union(hits)
        if d + 1 < depth:
            level = up.where(~F.col("next").isin("", NO_GUID) & (F.col("next") != F.col("at"))).select("computer", F.col("next").alias("at"), "base", "image", "below").distinct()
    found = stored(found.groupBy("computer", "root").agg(F.max("w").alias("w")), "tree-roots")
    level = found.select("computer", "root", F.col("root").alias("at"))
    below = None
    children = edges.select("computer", F.col("parent").alias("at"), "guid", "event", "sec")
    for _ in range(depth):
        step = level.join(children, ["computer", "at"]).where("guid <> root")
        below = step.drop("at") if below is None else below.union(step.drop("at"))
        level = step.select("computer", "root", F.col("guid").alias("at")).distinct()
    below = stored(below.distinct(), "tree-members")
    inner = below.select("computer", F.col("guid").alias("root")).distinct()
    found = found.join(inner, ["computer", "root"], "left_anti")
    severity = F.when(F.col("w") == 4, "critical").when(F.col("w") == 3, "high").otherwise("medium")
    top = found.join(roots.select("computer", F.col("guid").alias("root"), F.col("event").alias("chain"), F.col("sec").alias("root_s"), "user_name"), ["computer", "root"]).withColumn("severity", severity)
    leads = top.select("chain", "computer", "user_name", F.col("chain").alias("event"), F.col("root_s").alias("sec"), F.col("computer").alias("host"), F.lit(True).alias("lead"), F.lit(True).alias("listed"), "severity")
    others = top.join(below, ["computer", "root"]).select("chain", "computer", "user_name", "event", "sec", F.col("computer").alias("host"), F.lit(False).alias("lead"), F.lit(True).alias("listed"), "severity")
    return leads.union(others)


RULES = [brute_force, service_after_logon, weak_tickets, pass_the_hash, log_clearing, task_after_logon, account_after_recon, password_spray, script_after_shell, session_privileges, session_processes, many_hosts, process_trees]


def once_a_minute(chains: DataFrame) -> DataFrame:
    """Of chains of one rule, the same hosts and minute the first."""
    order = W.partitionBy("rule", "hosts", F.floor(F.col("first_s") / 60)).orderBy("first_s", "first_event")
    return chains.withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, r) for s, r in SEVERITY_RANK.items()], F.lit(0))


def by_severity(chains: DataFrame) -> DataFrame:
    """Chains in order of severity, the worst first, then of time."""
    return chains.orderBy(severity_rank(F.col("severity")).desc(), "first_s", "rule", "first_event")


def all_chains(log: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """Chains of all rules, and ``detections`` of other tools in the same columns: one per rule, hosts and minute, the worst first."""
    found = [rule(log) for rule in RULES] + ([detections] if detections is not None else [])
    # stored, as sorting by ranges would make all chains twice
    return by_severity(stored(once_a_minute(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)), "chains"))
