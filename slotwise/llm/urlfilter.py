"""URL filter: host and path rules, and gradient-boosted trees on lexical
features for the URLs that no rule decides.

Only DataFrame expressions and the DataFrame API of pyspark.ml are used. The
labelled URLs are those that a rule decides; the trees learn from a bounded
sample of them, dealt by hash, and judge every other URL. The statistics of a
labelled URL's suffix are those of the other folds, so a URL's own label is in
none of its features, and one fold is held out from fitting and statistics
alike to tell how well the trees do (``held_out_accuracy``).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import cut

#: Verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

FOLDS = 5  # of the labelled URLs; fold 0 is held out
BROADCAST, SALTS = 100_000, 16  # suffixes that are broadcast at most; parts of a suffix's rows beyond
SAMPLE = 20_000  # expected number of labelled rows that the trees learn from, at most
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix_rows", "f_suffix_block", "f_top_rows", "f_top_block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length("url"), F.lit(1)).cast("double")
    n = F.coalesce(n, F.lit(1.0))
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    surprise = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / n * F.log2(c / n))
    labels = F.split("host", r"\.")
    return pages.select(
        "*",
        n.alias("f_length"),
        F.length("path").cast("double").alias("f_path_length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("f_depth"),
        F.size(labels).cast("double").alias("f_labels"),
        ((F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n).alias("f_digits"),
        surprise.alias("f_entropy"),
        F.size(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")).cast("double").alias("f_params"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("f_hyphens"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("suffix"),
        F.element_at(labels, -1).alias("top"),
    )


def with_suffix_statistics(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows' suffix: how many rows have it, and its smoothed share of
    blocked rows among the labelled ones of the learning folds, but for the
    row's own fold. Pre-aggregated before the shuffle; a suffix may hold most
    of the rows, so beyond a size that is fit for a broadcast the rows are
    dealt to ``SALTS`` parts of their suffix."""
    blocked = [F.count_if((F.col("fold") == f) & (F.col("label") == "block")) for f in range(1, FOLDS)]
    labelled = [F.count_if((F.col("fold") == f) & F.col("label").isNotNull()) for f in range(1, FOLDS)]
    seen = cut(rows.groupBy(key).agg(F.count("*").alias("n"), F.array(*blocked).alias("b"), F.array(*labelled).alias("l")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    if seen.count() <= BROADCAST:
        joined = rows.join(F.broadcast(seen), key, "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        spread = seen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", salt).join(spread, [key, "salt"], "left").drop("salt")
    own = F.when(F.col("label").isNotNull() & (F.col("fold") > 0), F.col("fold"))  # whose labels are left out
    left_out = lambda c: total(c) - F.coalesce(F.get(c, own.cast("int") - 1), F.lit(0))
    share = (left_out(F.col("b")) + 1.0) / (left_out(F.col("l")) + 2.0)
    return joined.withColumns({f"f_{key}_rows": F.log1p(F.col("n").cast("double")), f"f_{key}_block": share}).drop("n", "b", "l")


def featured(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, label, fold and the features of every URL."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    name, verdict = rule_columns(rules)
    # copies of a URL are of one fold, so none is learned from that is tested
    rows = lexical(rows.withColumns({"rule": name, "label": verdict, "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")}))
    for key in ("suffix", "top"):
        rows = with_suffix_statistics(rows, key)
    return rows


def fitted(rows: DataFrame, sample: int, rounds: int, depth: int):
    """The vectors of all rows, and a function from them to the scored rows;
    None instead of it where the labels outside the held-out fold are of one
    kind, which is given, too (allow, if there is none)."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    known = rows.where("label is not null and fold > 0")
    kinds = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return vectors, None, next(iter(kinds), "allow")
    share = min(1.0, sample / sum(kinds.values()))
    # copies of a page carry the same hash, the page's id tells them apart
    chosen = F.pmod(F.xxhash64("url", "page_id"), F.lit(2**30)) < int(share * 2**30)
    learned = cut(vectors.where(F.col("label").isNotNull() & (F.col("fold") > 0) & chosen).select("features", (F.col("label") == "block").cast("double").alias("target")))
    trees = GBTClassifier(labelCol="target", featuresCol="features", maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7).fit(learned)
    return vectors, lambda v: trees.transform(v).withColumn("p_block", vector_to_array("probability")[1]), None


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, rounds: int = 12, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of a
    block (null where they were not fitted).

    Null and empty URLs have an empty host and path and are judged by the
    trees like others, as are very long ones; repeated rows are judged alike
    and kept; further columns, whatever their names, play no part; with no
    labelled URLs, or labels of one kind, the verdict outside the rules is that
    kind, or allow. An empty table gives no rows.
    """
    vectors, score, only = fitted(featured(pages, rules), sample, rounds, depth)
    if score is None:
        return vectors.select("page_id", "host", "path", "rule", F.coalesce("label", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    by_trees = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return score(vectors).select("page_id", "host", "path", "rule", F.coalesce("label", by_trees).alias("verdict"), "p_block")


def held_out_accuracy(pages: DataFrame, rules=RULES, sample: int = SAMPLE, rounds: int = 12, depth: int = 4) -> DataFrame:
    """One row: n, accuracy of the trees, and majority (the share of the more
    frequent verdict), over the labelled URLs of the held-out fold."""
    vectors, score, only = fitted(featured(pages, rules), sample, rounds, depth)
    held = vectors.where("label is not null and fold = 0")
    scored = score(held) if score else held.withColumn("p_block", F.lit(float(only == "block")))
    block = F.col("label") == "block"
    share = F.avg(block.cast("double"))
    return scored.agg(F.count("*").alias("n"), F.avg(((F.col("p_block") >= 0.5) == block).cast("double")).alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))
