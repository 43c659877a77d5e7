"""URL filters: rules first, else trust and distrust that spread over the links between hosts.

Rules are ``(action, host, path)``.  One fits its host and all subdomains of it, if the url's
path starts with the rule's.  The longest that fits wins (host and path together; among equals
the longer host).

Where no rule fits, the host decides.  Hosts with pages that rules allow are trusted seeds, hosts
with pages that rules block are blocked seeds, each by the share of its ruled pages.  Trust is a
personalised PageRank from the trusted seeds along links; distrust is one from the blocked seeds
against them, so a host that links to blocked ones is distrusted.  A host is blocked where its
distrust is more than ``RATIO`` percent of its trust; one that neither reaches is allowed.

Links are the ``href`` of ``<a>`` with a host of their own; those that stay on a host tell
nothing and go.  Scores are whole numbers (``UNIT`` for a seed) and every quotient is rounded
down, so that sums don't depend on the order of rows: a lost executor, or another engine, gives
the same verdicts.

Defined results: a null url, and one without ``://``, has an empty host and path, no rule, and is
allowed; a null html has no links; repeated rows are judged alike and counted each; other columns,
``host`` or ``verdict`` of the input among them, are not read; an empty table gives an empty
result; whole pages are searched, however long.

Only DataFrame operations run here.  Edges of a host with very many are dealt over several tasks
(``_FAN``), scores follow them; tables of a round are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import discard, materialize

Rule = tuple[str, str, str]

#: The rules of the registered query.
RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Share of a score that goes on along links, in percent; rounds at most; percent of trust that distrust must pass.
DAMPING, ROUNDS, RATIO = 85, 30, 100
#: Score of a seed with only allowed (or only blocked) pages.
UNIT = 1_000_000_000
#: Edges of one host that one task gets; parts that the pages of one host are dealt to.
_FAN, _SALT = 20_000, 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Start of an absolute or scheme-less link in an anchor, up to the end of its host.
_LINK = r"""<[Aa][ \t\n\r\f](?:[^<>]*?[ \t\n\r\f])?[Hh][Rr][Ee][Ff][ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"'<> \t\n\r\f]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], field: int | None = None) -> Column:
    """Text of the rule that fits (``field``: its action, 0), null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(_longest_first(rules)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, rule[1] + rule[2] if field is None else rule[field]).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """u, v, n: how many links the pages of host u have to host v."""
    found = pages.select(host_of(F.col(url)).alias("u"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("v"))
    found = found.select("u", F.translate("v", _UPPER, _LOWER).alias("v"))
    return found.where("u <> '' and u <> v").groupBy("u", "v").agg(F.count("*").alias("n"))


def host_seeds(judged: DataFrame) -> DataFrame:
    """host, allowed, blocked of hosts with ruled pages; ``judged`` has host and action."""
    return (
        judged.where("host <> '' and action is not null")
        .groupBy("host")
        .agg(F.count(F.when(F.col("action") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("action") == "block", 1)).alias("blocked"))
    )


def _edges(links: DataFrame) -> DataFrame:
    """src, kind, part, dst, n, total, parts: each link forwards (kind 0) and backwards (kind 1), a source's edges in parts."""
    both = links.select(F.col("u").alias("src"), F.lit(0).alias("kind"), F.col("v").alias("dst"), "n")
    both = both.union(links.select("v", F.lit(1), "u", "n"))
    totals = both.groupBy("src", "kind").agg(F.sum("n").alias("total"), F.expr(f"1 + count(*) div {_FAN}").alias("parts"))
    # the totals of a hub meet its edges in parts, too
    salted = both.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(_SALT)))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return salted.join(totals, ["src", "kind", "salt"]).select("src", "kind", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part"), "dst", "n", "total", "parts")


def propagate(links: DataFrame, seeds: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """node, kind, score: trust (kind 0) and distrust (1) of each host that has some.

    ``links`` as of ``host_links``, ``seeds`` as of ``host_seeds``.  Ends when no score moves.
    """
    edges = materialize(_edges(links), "host-edges")
    share = lambda c: F.expr(f"({UNIT} * {c} div (allowed + blocked)) * {100 - damping} div 100")
    start = seeds.select("host", share("allowed").alias("allowed"), share("blocked").alias("blocked"))
    base = start.select(F.col("host").alias("node"), F.lit(0).alias("kind"), F.col("allowed").alias("score")).union(start.select("host", F.lit(1), "blocked"))
    base = materialize(base.where("score > 0"), "host-seeds")
    parts = edges.select("src", "kind", "part", "parts").distinct()
    flow = f"(cast(score as decimal(20,0)) * cast(n * {damping} as decimal(15,0))) div cast(total * 100 as decimal(15,0))"
    state, seen, spent = base, base.agg(F.count("*"), F.sum(F.xxhash64("node", "kind", "score").cast("decimal(38,0)"))).first(), None
    for _ in range(rounds):
        spread = state.join(parts, (F.col("node") == F.col("src")) & (state.kind == parts.kind)).select("src", parts.kind, "part", "score")
        moved = edges.join(spread, ["src", "kind", "part"]).select(F.col("dst").alias("node"), "kind", F.expr(flow).alias("score"))
        new = materialize(moved.union(base).groupBy("node", "kind").agg(F.sum("score").alias("score")).where("score > 0"), "host-scores")
        if spent is not None:
            discard(spent)
        state = spent = new
        now = state.agg(F.count("*"), F.sum(F.xxhash64("node", "kind", "score").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    discard(edges)
    return state


def blocked_hosts(scores: DataFrame, ratio: int = RATIO) -> DataFrame:
    """host, trust, distrust of the hosts that ``propagate`` finds against."""
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0))
    by_host = scores.groupBy(F.col("node").alias("host")).agg(side(0).alias("trust"), side(1).alias("distrust"))
    return by_host.where(f"cast(distrust as decimal(20,0)) * 100 > cast(trust as decimal(20,0)) * {ratio}")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: int = DAMPING, rounds: int = ROUNDS, ratio: int = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url, html)."""
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = at.select("*", rule_of(host, path, rules).alias("rule"), rule_of(host, path, rules, 0).alias("action"))
    scores = propagate(host_links(pages), host_seeds(judged), damping, rounds)
    blocked = blocked_hosts(scores, ratio).select("host", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"), F.lit("block").alias("by_host"))
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(_SALT)).cast("int"))
    found = salted.join(blocked, ["host", "salt"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", "by_host", F.lit("allow")).alias("verdict"))


def _sql_rule(field: int | None) -> str:
    whens = []
    for rule in _longest_first(RULES):
        value = rule[1] + rule[2] if field is None else rule[field]
        whens.append(f"WHEN (host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}') THEN '{value}'")
    return "CASE " + " ".join(whens) + " END"


def _sql() -> str:
    """The same in DuckDB: the rounds one after the other."""
    link = _LINK.replace("'", "''")
    lower = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    ctes = [
        f"""hosted AS (SELECT page_id, html, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"judged AS MATERIALIZED (SELECT page_id, host, path, {_sql_rule(None)} AS rule, {_sql_rule(0)} AS action FROM hosted)",
        f"""links AS MATERIALIZED (SELECT u, v, count(*) AS n FROM (SELECT host AS u, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS v FROM hosted)
  WHERE u <> '' AND u <> v GROUP BY u, v)""",
        """edges AS MATERIALIZED (SELECT u AS src, 0 AS kind, v AS dst, n, sum(n) OVER (PARTITION BY u) AS total FROM links
  UNION ALL SELECT v, 1, u, n, sum(n) OVER (PARTITION BY v) FROM links)""",
        "counts AS (SELECT host, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked FROM judged WHERE host <> '' AND action IS NOT NULL GROUP BY host)",
        f"""base AS MATERIALIZED (SELECT host AS node, 0 AS kind, ({UNIT} * allowed // (allowed + blocked)) * {100 - DAMPING} // 100 AS score FROM counts
  UNION ALL SELECT host, 1, ({UNIT} * blocked // (allowed + blocked)) * {100 - DAMPING} // 100 FROM counts)""",
        "s0 AS MATERIALIZED (SELECT * FROM base)",
    ]
    for k in range(1, ROUNDS + 1):
        ctes.append(
            f"""s{k} AS MATERIALIZED (SELECT node, kind, CAST(sum(score) AS BIGINT) AS score FROM (SELECT * FROM base UNION ALL
  SELECT dst, e.kind, CAST(score::HUGEINT * (n * {DAMPING}) // (total * 100) AS BIGINT) FROM edges e JOIN s{k - 1} s ON s.node = e.src AND s.kind = e.kind)
  GROUP BY node, kind)"""
        )
    ctes.append(
        f"""blocked AS (SELECT node FROM s{ROUNDS} GROUP BY node
  HAVING coalesce(sum(score) FILTER (kind = 1), 0) * 100 > coalesce(sum(score) FILTER (kind = 0), 0) * {RATIO})"""
    )
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict FROM judged"


ORACLE_SQL = _sql()
