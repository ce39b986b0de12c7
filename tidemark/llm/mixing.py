"""Mixing sources to target weights by soft membership: DataFrame functions only.

1. A classifier learned from a labelled table gives each document posteriors over domains: log ratios of
   hashed words and of marked words (shouted, exclaimed, sign-laden, separators) against the whole sample,
   shrunk towards nothing for rare words, with the evidence of a text limited to EVIDENCE words' worth.
2. Rates r >= 0 are fitted by projected gradient: with n_i tokens and posteriors p_id, the expected share
   of domain d is sum(n_i p_id r_i) / sum(n_i), and its difference from the target is to vanish. A step
   lowers r_i by the posterior-weighted, scaled residuals and cuts it off at 0. A pass over (tokens, posteriors)
   gives a sum for each domain and pair of domains; nothing else comes to the driver.

Learning uses a bounded sample of labelled rows (SAMPLE, those with the least key hashes); the weights
table has at most BUCKETS rows, so it is sent to all. Everything else covers all rows.

Defined results: NULL and empty texts have 0 tokens, the prior as posteriors, and a rate of their own that
moves no total; a domain label NULL is no label; of several labels of a key the least counts; without labels all domains have the
same posterior; targets that nothing can meet leave the least residual that steps lead to, told in reached_<domain>.
Repeated rows get equal rates; a very long text is a row like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_stored, keyed_uniform, read, stored

SAMPLE = 8000
BUCKETS = 1 << 18
SHRINK, EVIDENCE = 5.0, 64
#: Passes at the most (a fit takes about ten), the relative distance from a target that is close enough, the least share of a step.
ROUNDS, CLOSE, LEAST_STEP = 200, 1e-4, 1e-3
#: Steps that are kept as one expression before the rates are written down.
CHAIN = 8
MARKS = ("exclaimed", "signs", "separator", "shouted")
TARGETS = {"good": 0.92, "poor": 0.07, "toxic": 0.01}


def words(docs: DataFrame, key: str, text: str, *keep: Column) -> DataFrame:
    """A row for each word of each document (one without a word for an empty text): row, key, token, bucket, marks."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")
    # Rows are numbered below the generator: in one projection with it, the number would be each word's.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("th"), *keep, split.alias("words"))
    rows = numbered.select(*[c for c in numbered.columns if c != "words"], F.explode_outer("words").alias("word"))
    last = F.substring("word", -1, 1)
    mark = F.when(last == "!", 0).when(F.col("word") == "|", 2).when(last.isin("%", "*", "&", "$", "#", "@", "~", "^", "|"), 1).when((F.length("word") > 2) & (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word")), 3)
    return rows.select("row", "key", "th", *[x for x in rows.columns if x not in ("row", "key", "th", "word")], (F.length("word") > 0).cast("long").alias("token"), F.pmod(F.xxhash64(F.lower("word")), F.lit(BUCKETS)).alias("bucket"), mark.alias("mark"))


class Classifier:
    """Priors and mark weights by domain, and a table of bucket weights."""

    def __init__(self, domains: list[str], priors: list[float], marks: list[list[float]], weights: DataFrame | None) -> None:
        self.domains, self.priors, self.marks, self.weights = domains, priors, marks, weights


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text") -> Classifier:
    """labelled: key, domain."""
    known = labelled.where(F.col("domain").isin(domains) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("domain").alias("_d"))
    sizes = {r["_d"]: r["n"] for r in known.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier(domains, [1 / len(domains)] * len(domains), [[0.0] * len(domains)] * len(MARKS), None)
    some = known.where(keyed_uniform(F.col("_k"), F.lit("mix")) < min(1.1, SAMPLE / total))
    # Of rows that repeat a key, the least text counts: the sample is bounded in rows.
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(some), "_k").groupBy("_k", "_d").agg(F.min("_t").alias(text)).withColumnRenamed("_k", key)
    tokens = words(sample, key, text, F.col("_d").alias("d")).where("token = 1")
    each = [F.count_if(F.col("d") == x).cast("double").alias(f"c{i}") for i, x in enumerate(domains)]
    counts = cut(tokens.groupBy("bucket").agg(*each))
    sums = counts.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(domains))]).first()
    by_domain = [sums[i] or 0.0 for i in range(len(domains))]
    every = max(1.0, sum(by_domain))

    def ratio(c: Column, i: int, of: Column) -> Column:
        return F.log((c + SHRINK) / (of * (by_domain[i] / every) + SHRINK))

    whole = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0.0))
    weights = counts.select("bucket", *[ratio(F.col(f"c{i}"), i, whole).alias(f"w{i}") for i in range(len(domains))]).where(" OR ".join(f"abs(w{i}) > 0.1" for i in range(len(domains))))
    marked = {r["mark"]: r for r in tokens.where("mark IS NOT NULL").groupBy("mark").agg(*each).collect()}
    marks = []
    for m in range(len(MARKS)):
        c = [marked[m][f"c{i}"] if m in marked else 0.0 for i in range(len(domains))]
        marks.append([math.log((c[i] + SHRINK) / (sum(c) * by_domain[i] / every + SHRINK)) for i in range(len(domains))])
    return Classifier(domains, [(sizes.get(x, 0) + 1) / (total + len(domains)) for x in domains], marks, cut(weights))


def posteriors(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th, tokens, p0, p1, ... of each row."""
    n = range(len(model.domains))
    tokens = words(docs, key, text)
    if model.weights is not None:
        tokens = tokens.join(F.broadcast(model.weights), "bucket", "left")
    score = [F.sum(F.col(f"w{i}")).alias(f"s{i}") for i in n] if model.weights is not None else []
    marks = [F.count_if(F.col("mark") == m).alias(f"m{m}") for m in range(len(MARKS))]
    sums = tokens.groupBy("row", "key", "th").agg(F.sum("token").alias("tokens"), *score, *marks)
    damp = F.lit(float(EVIDENCE)) / F.greatest(F.lit(float(EVIDENCE)), F.col("tokens").cast("double"))
    logit = []
    for i in n:
        s = F.coalesce(F.col(f"s{i}"), F.lit(0.0)) if model.weights is not None else F.lit(0.0)
        for m in range(len(MARKS)):
            s = s + F.col(f"m{m}") * model.marks[m][i]
        logit.append((s * damp + math.log(model.priors[i])).alias(f"z{i}"))
    scored = sums.select("key", "th", "tokens", *logit)
    top = F.greatest(*[F.col(f"z{i}") for i in n]) if len(n) > 1 else F.col("z0")
    powers = scored.select("key", "th", "tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in n])
    whole = sum((F.col(f"e{i}") for i in n), F.lit(0.0))
    return powers.select("key", "th", "tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in n])


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """x of matrix x = right, a domain in each row: elimination with the largest pivot; a row that depends on others gives 0."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    pivots: list[tuple[int, int]] = []
    free = list(range(n))
    for c in range(n):
        at = max(free, key=lambda i: abs(rows[i][c]), default=None)
        if at is None or abs(rows[at][c]) < 1e-12:
            continue
        free.remove(at)
        pivots.append((at, c))
        for i in range(n):
            if i != at:
                f = rows[i][c] / rows[at][c]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[at], strict=True)]
    out = [0.0] * n
    for i, c in pivots:
        out[c] = rows[i][n] / rows[i][c]
    return out


def fit_rates(table: DataFrame, targets: list[float], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, list[float]]:
    """table (tokens, p0, ...) with a column rate; and the shares that the rates reach.

    The least squares are measured by the inverse of the Gram matrix of the rows that a step can move (rate above 0):
    its gradient, scaled so, would reach the targets at once if no rate were cut off at 0. A step that leaves a larger
    residual than the one before is taken back and halved. A round is one pass, which returns D + D (D + 1) / 2 sums.
    It ends when all shares are within `close` of their targets, or when a step of LEAST_STEP still makes things worse: then
    no rates near these do better, and the shares reached say how far that is.
    """
    n = range(len(targets))
    weight = sum(targets)
    want = [x / weight for x in targets]
    total = float(table.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return table.withColumn("rate", F.lit(1.0)), [0.0] * len(targets)
    pair = [(i, j) for i in n for j in n if i <= j]
    size = [max(w, 1e-3) for w in want]

    def passed(rate: Column) -> tuple[list[float], list[list[float]]]:
        at = table.withColumn("rate", rate).withColumn("moves", F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0.0))
        got = at.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}") * F.col("rate")).alias(f"a{i}") for i in n], *[F.sum(F.col("moves") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i, j in pair]).first()
        return [float(got[f"a{i}"]) / total - want[i] for i in n], [[float(got[f"g{min(i, j)}_{max(i, j)}"]) / total for j in n] for i in n]

    def moved(rate: Column, by: list[float]) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((F.col(f"p{i}") * by[i] for i in n), F.lit(0.0)))

    kept: Column = F.lit(1.0)
    error, gram = passed(kept)
    step, share, since = solved(gram, error), 1.0, 0
    for _ in range(rounds):
        worst = max(abs(e) / z for e, z in zip(error, size, strict=True))
        if worst < close or share < LEAST_STEP:
            break
        tried = moved(kept, [share * x for x in step])
        next_error, next_gram = passed(tried)
        if max(abs(e) / z for e, z in zip(next_error, size, strict=True)) >= worst:
            share /= 2
            continue
        kept, error, since = tried, next_error, since + 1
        step, share = solved(next_gram, error), min(1.0, 2 * share)
        if since % CHAIN == 0:
            before, table = table, stored(table.drop("rate").withColumn("rate", kept), "rates")
            if since > CHAIN:
                drop_stored(before)
            kept = F.col("rate")
    return table.withColumn("rate", kept), [e + w for e, w in zip(error, want, strict=True)]


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th (hash of the text), tokens, domain (most likely), p_<domain>, rate, copies, reached_<domain> of each row.

    copies = floor(rate + u), u uniform by key, so that its expectation is the rate. reached_<domain> is the same in all
    rows: the share of all tokens that the rates give the domain, to be held against its target."""
    domains = sorted(targets)
    table = stored(posteriors(docs, learn(docs, labelled, domains, key, text), key, text), "posteriors")
    rated, reached = fit_rates(table, [targets[d] for d in domains])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(d).alias("d")) for i, d in enumerate(domains)]))["d"]
    return rated.select(
        F.col("key").alias(key),
        "th",
        "tokens",
        best.alias("domain"),
        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate",
        F.floor(F.col("rate") + keyed_uniform(F.col("key"), F.col("th"), F.lit("copies"))).cast("int").alias("copies"),
        *[F.lit(x).alias(f"reached_{d}") for d, x in zip(domains, reached, strict=True)],
    )


def apply_rates(docs: DataFrame, rated: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs as often as its copies say, with the columns it came with."""
    # Long names, so that no column of docs is meant by mistake.
    rates = rated.select(F.col(key).alias("_rate_key"), F.col("th").alias("_rate_text"), F.col("copies").alias("_rate_copies")).dropDuplicates(["_rate_key", "_rate_text"])
    joined = docs.join(rates, F.col(key).eqNullSafe(F.col("_rate_key")) & (F.xxhash64(text) == F.col("_rate_text")))
    return joined.where("_rate_copies > 0").withColumn("_rate_copy", F.explode(F.array_repeat(F.lit(0), F.col("_rate_copies")))).select(*docs.columns)


def domains_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") == 0, "poor")
    return labels.select(key, domain.alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(read(spark, sf_dir, "documents"), domains_of(read(spark, sf_dir, "labels")), TARGETS)
    return found.drop("th")
