"""URL filters: rules by host and path, and link-graph propagation for urls no rule fits.

Hosts that rules mostly allow are trusted seeds, hosts that rules mostly block are distrusted seeds. Trust spreads along the
links between hosts and distrust against them (a host that links to blocked hosts is suspect), both by personalised PageRank
with the seeds as its jump target, as joins and sums over the host edges. Every seed jumps with weight one, whatever their
number, so a part of the graph has the same scores alone and in a large crawl. A host is blocked if the share of distrust
in its trust plus distrust is above ``MAX_SHARE``; a host without evidence is allowed.

Pages are only ever joined by host with one row for each host; a host with a third of all pages is on the side that Spark
may split. Links are counted by pair of hosts with partial sums before any exchange.

Links are the absolute ones of a page (``href`` of ``http:``, ``https:`` or ``//``); a relative link stays on its host and gives no
edge between hosts.

Defined results: a null url, or one without ``://``, has empty host and path; no rule with a host fits it and it is
allowed. Null html has no links. Repeated rows are judged one by one; repeated rules count once; of rules of equal length
the one that blocks wins. Other columns pass through, whatever their names; columns called like a result make place for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ascii_lower, discard, from_row, with_row, written

#: TOLERANCE is the largest change of any host's score, as a share of it, at which rounds end early.
DAMPING, TOLERANCE = 0.85, 1e-4
#: Rounds at most: what a seed has not given away then is under 1e-4 of it (DAMPING ** ROUNDS), however long the paths are.
ROUNDS = 57
MAX_SHARE = 0.5
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\shref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"

# The rules of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(verdict, "host/path") pairs to a table; a rule's path begins at its first slash."""
    rows = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")
    return rows.select("verdict", "rule", ascii_lower(F.substring_index("rule", "/", 1)).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) to (host, rules array<struct<size, blocks, rule, verdict, prefix>>), by each host's own suffixes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = hosts.filter("host <> ''").select("host", F.explode(suffixes).alias("suffix"))
    fit = F.struct(F.length("rule").alias("size"), (F.col("verdict") == "block").cast("int").alias("blocks"), "rule", "verdict", "prefix")
    return each.join(rules.dropDuplicates(["verdict", "rule"]), "suffix").groupBy("host").agg(F.collect_set(fit).alias("rules"))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): pages of host src that link to another host dst."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: ascii_lower(x)))
    pairs = pages.select(F.col("_tw_host").alias("src"), F.explode(found).alias("dst"))
    return pairs.filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges (src, dst, n), seeds (host, trust, distrust) to (host, trust, distrust) after personalised PageRank, of ``rounds`` at most."""
    edges = written(edges, "host-edges")
    scaled = [[F.lit(kind).alias("kind"), "host", F.col(kind).cast("double").alias("seed")] for kind in ("trust", "distrust")]
    start = seeds.select(*scaled[0]).union(seeds.select(*scaled[1])).filter("seed > 0")
    start = written(start, "host-seeds")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    moves = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "host-moves")
    score = start_score = start.withColumnRenamed("seed", "score")
    if moves.isEmpty():
        rounds = 0
    for _ in range(rounds):
        moved = score.join(moves, (score.host == moves.src) & (score.kind == moves.kind)).select(moves.kind, moves.dst.alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score"))
        jump = start.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score"))
        after = written(moved.unionByName(jump).groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-scores")
        new, old = F.coalesce("new", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
        moved_by = F.when(F.greatest(new, old) > 0, F.abs(new - old) / F.greatest(new, old))
        change = after.withColumnRenamed("score", "new").join(score, ["kind", "host"], "full").agg(F.max(moved_by)).first()[0]
        if score is not start_score:
            discard(score)
        score = after
        if (change or 0) < TOLERANCE:
            break
    discard(edges)
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return score.groupBy("host").agg(pick("trust"), pick("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """pages without the html column, plus _tw_host, _tw_path, _tw_rule, _tw_verdict, _tw_trust and _tw_distrust."""
    spark, said = pages.sparkSession, F.col(url).cast("string")
    located = with_row(pages, (html,), _tw_host=host_of(said), _tw_path=path_of(said))
    hosts = located.select(F.col("_tw_host").alias("host")).distinct()
    ruled = written(rules_by_host(hosts, rule_table(spark, rules)).withColumnsRenamed({"host": "_tw_host", "rules": "_tw_rules"}), "host-rules")

    def judged(side: DataFrame) -> DataFrame:
        fits = F.filter("_tw_rules", lambda r: F.col("_tw_path").startswith(r.prefix))
        return side.join(ruled, "_tw_host", "left").withColumn("_tw_best", F.array_max(fits))

    counts = judged(located.select("_tw_host", "_tw_path")).groupBy(F.col("_tw_host").alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("_tw_best.verdict") == "allow").alias("allowed"), F.count_if(F.col("_tw_best.verdict") == "block").alias("blocked"))
    seeds = counts.filter("host <> ''").select("host", (2 * F.col("allowed") > F.col("n")).cast("double").alias("trust"), (2 * F.col("blocked") > F.col("n")).cast("double").alias("distrust"))
    edges = spark.createDataFrame([], "src string, dst string, n long")
    if html in pages.columns:
        edges = host_edges(pages.select(host_of(said).alias("_tw_host"), F.col(html).cast("string").alias("html")))
    scores = propagate(edges, written(seeds, "host-counts"))
    scores = scores.select(F.col("host").alias("_tw_host"), F.col("trust").alias("_tw_trust"), F.col("distrust").alias("_tw_distrust"))
    suspect = F.col("_tw_distrust") > MAX_SHARE * (F.col("_tw_trust") + F.col("_tw_distrust"))
    by_method = F.when(F.coalesce(suspect, F.lit(False)), "block").otherwise("allow")
    out = judged(located).join(scores, "_tw_host", "left").withColumns({"_tw_rule": F.col("_tw_best.rule"), "_tw_verdict": F.coalesce("_tw_best.verdict", by_method)})
    results = ("_tw_host", "_tw_path", "_tw_rule", "_tw_verdict", "_tw_trust", "_tw_distrust")
    return from_row(out, [c for c in pages.columns if c != html], **{c: c for c in results})


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", F.col("_tw_host").alias("host"), F.col("_tw_path").alias("path"), F.col("_tw_rule").alias("rule"), F.col("_tw_verdict").alias("verdict"))

