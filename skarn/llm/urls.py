"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Rows that the trees are fitted on, about; buckets of a suffix table; weight of an even rate in a suffix's rate.
TRAIN_ROWS, BUCKETS, PRIOR = 20_000, 4096, 10.0
#: Parts of the labelled rows; a row that is learnt from has its suffix's rate from the other parts.
FOLDS = 5
#: Probability from which the trees block: both classes weigh alike, so 0.5 says nothing, and doubt allows.
LEAST = 0.8
FEATURES = ("f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_longest", "f_domain_rate", "f_file_rate")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(text: str) -> list[Rule]:
    """Rules like ``allow com/, block example.com/en/``."""
    told = (r.split() for r in text.split(",") if r.strip())
    return [Rule(verdict, rule[: rule.index("/")], rule[rule.index("/") :]) for verdict, rule in told]


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host (A-Z lower-cased), path and query; all empty where url is null or has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract("url", PARTS, i), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2), "query": part(3)})


def rule_of(rules: list[Rule]) -> Column:
    """Text of the longest rule that fits host and path, else null; of equal lengths the longer host wins."""
    best = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        host = (F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))
        best = F.when(host & F.startswith("path", F.lit(r.path)), F.lit(r.text)).otherwise(best)
    return best


def _bucket(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS))


def with_features(pages: DataFrame) -> DataFrame:
    """Lexical features of (url, host, path, query), and the buckets of the two suffixes whose rates are learnt."""
    url, size = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    signs = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    return pages.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_labels": F.size(F.split("host", "\\.")).cast("double"),
        "f_depth": F.size(segments).cast("double"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
        "f_entropy": entropy,
        "f_params": F.when(F.col("query") == "", 0.0).otherwise(F.size(F.split("query", "&")).cast("double")),
        "f_hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
        "f_longest": F.coalesce(F.array_max(F.transform(F.split("host", "\\."), F.length)), F.lit(0)).cast("double"),
        "domain": _bucket(F.substring_index("host", ".", -1)),
        "file": _bucket(F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise("")),
    })


@dataclass(frozen=True)
class Model:
    """Rates of blocked URLs by suffix bucket, at most ``BUCKETS`` rows each, and the trees; none without two classes."""

    rates: dict[str, DataFrame]
    trees: PipelineModel | None

    def probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a double ``probability`` of being blocked; without trees it is 0."""
        if self.trees is None:
            return rows.withColumn("probability", F.lit(0.0))
        found = self.trees.transform(_with_rates(rows, self.rates))
        return found.withColumn("probability", vector_to_array("probability")[1])

    def blocked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a boolean ``blocked``; without trees nothing is blocked."""
        return self.probability(rows).withColumn("blocked", F.col("probability") >= LEAST)


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame], *by: str) -> DataFrame:
    for name, rate in rates.items():
        rows = rows.join(F.broadcast(rate), [name, *by], "left").withColumn(f"f_{name}_rate", F.coalesce(f"f_{name}_rate", F.lit(0.5)))
    return rows


def with_fold(rows: DataFrame) -> DataFrame:
    """``rows`` with the part (``fold``) that a URL is of, equal URLs in one part."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Trees from rows of ``with_features`` with a ``label`` (1.0: block, 0.0: allow).

    What is labelled need not be like the rest, so both classes weigh alike, and a suffix never seen has an even rate.
    The rates cover all labelled rows; a row that the trees learn from has those of the other ``FOLDS`` - 1 parts, so
    that its own label never speaks for it. The trees are fitted on a sample of about ``train_rows`` rows, drawn by a
    hash of the URL; that bound is the only one.
    """
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    labelled = with_fold(labelled).withColumn("weight", F.when(F.col("label") > 0.5, n / (2 * max(blocked, 1))).otherwise(n / (2 * max(n - blocked, 1))))
    rates, others = {}, {}
    spark = labelled.sparkSession
    for name in ("domain", "file"):
        parts = labelled.groupBy(name, "fold").agg(F.sum(F.col("label") * F.col("weight")), F.sum("weight")).collect()
        whole: dict[int, list[float]] = {}
        for bucket, _, block, weight in parts:
            total = whole.setdefault(bucket, [0.0, 0.0])
            total[0] += block
            total[1] += weight
        mine = {(b, f): (block, weight) for b, f, block, weight in parts}
        rate = lambda block, weight: (max(block, 0.0) + PRIOR / 2) / (max(weight, 0.0) + PRIOR)
        rates[name] = spark.createDataFrame([(b, rate(*t)) for b, t in whole.items()], f"{name} long, f_{name}_rate double")
        left = [(b, f, rate(t[0] - mine.get((b, f), (0, 0))[0], t[1] - mine.get((b, f), (0, 0))[1])) for b, t in whole.items() for f in range(FOLDS)]
        others[name] = spark.createDataFrame(left, f"{name} long, fold long, f_{name}_rate double")
    if not 0 < blocked < n:
        return Model(rates, None)
    part = min(1.0, train_rows / n)
    sample = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = _with_rates(sample, others, "fold").select("label", "weight", *FEATURES)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = assembler.transform(sample).select("label", "weight", "features")
    trees = GBTClassifier(weightCol="weight", maxIter=15, maxDepth=4, stepSize=0.3, seed=11, checkpointInterval=-1).fit(rows)
    return Model(rates, PipelineModel([assembler, trees]))


def judge(pages: DataFrame, rules: list[Rule], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, by) of every row of ``pages`` (page_id, url).

    The longest rule that fits decides; where none does, the trees, taught by the URLs that rules decide. A null url or
    one without ``://`` has an empty host and path and is left to the trees. Repeated rows come back repeated, further
    columns are ignored, and an empty table gives an empty table. Rules are a stated list; nothing is shuffled but the
    counts of the rates and what fitting gathers.
    """
    rows, labelled, label = labelled_rows(pages, rules)
    judged = fit(labelled, train_rows).blocked(rows).withColumn("block", F.when(F.col("rule").isNull(), F.col("blocked")).otherwise(label > 0.5))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("block"), "block").otherwise("allow").alias("verdict"), F.when(F.col("rule").isNull(), "trees").otherwise("rule").alias("by"))


def labelled_rows(pages: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame, Column]:
    """All rows with their rule and features, those that a rule decides with their label, and the label's expression."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = with_features(with_parts(rows)).withColumn("rule", rule_of(rules))
    label = F.when(F.col("rule").isin([r.text for r in rules if r.verdict == "block"]), 1.0).otherwise(0.0)
    return rows, rows.filter("rule is not null").withColumn("label", label), label
