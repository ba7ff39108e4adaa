"""Quality rules: base limits, then robust multivariate outliers.

Documents that pass the base limits are described by transformed statistics. For
each language and source, and for each language, a minimum covariance determinant
estimate is made: the mean and covariance of the three quarters of the documents
that have the least determinant. The search follows the deterministic form of the
fast algorithm: from three starts (medians with absolute deviations; mean and
covariance of all; the correlation of hyperbolic tangents of standardised values),
concentration steps take the documents nearest to an estimate for the next one. After
``TRIAL`` steps the start with the least determinant is kept and followed until
its determinant settles. Statistics that are equal for most documents would make it
zero, so a least variance is added to each (a regularised determinant).

A group's estimate is drawn towards that of its language by ``n / (n + SHRINK)``, so a
small group is judged mostly by its language and no size decides between two ways.
Documents whose squared Mahalanobis distance exceeds the 0.999 quantile of chi-square
are rejected.

All is DataFrame code. Texts are read once; the steps run over the table of
statistics, and each exchanges histograms and moments, one row for a group and
task, so a group with a third of all rows is summed before it is shuffled.

Defined results: null and empty texts have no words and fail the base limits;
null languages and sources are groups of their own; every row is judged by
itself, repeated or not; the only document of a language is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import split_words
from lodestone.llm.workspace import fresh, hinted, materialise, settled, table

#: Share of a group that the estimate rests on.
SUPPORT = 0.75
#: Scale of the covariance of the 75 % nearest of five normal variables: 0.75 / F7(q), F5(q) = 0.75.
CONSISTENCY = 1.412
#: Squared distance beyond which a document is an outlier: the 0.999 quantile of chi-square with five degrees of freedom.
CUT = 20.515
#: Documents at which a group's own estimate and that of its language weigh the same.
SHRINK = 50
#: Concentration steps from each start; fall of the log determinant below which the best one has settled.
TRIAL, SETTLED = 2, 1e-3
#: Statistics and the least standard deviation taken for each.
FEATURES = {"x_length": 0.25, "x_word": 0.2, "x_symbols": 0.1, "x_lines": 0.08, "x_repeats": 0.08}


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    Three-word windows are compared by a 64-bit hash inside one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = {x: fresh(docs, x) for x in ("w", "lines", "h", "twice", "s", "p")}
    c = {x: F.col(y) for x, y in n.items()}
    d = docs.withColumn(n["w"], split_words(text)).withColumn(
        n["lines"], F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    )
    d = d.withColumn(n["h"], F.transform(c["w"], lambda x, i: F.xxhash64(x, F.get(c["w"], i + 1), F.get(c["w"], i + 2))))
    d = d.withColumn(n["h"], F.slice(c["h"], F.lit(1), F.greatest(F.lit(0), F.size(c["w"]) - 2)))
    d = d.withColumn(n["twice"], F.size(c["h"]) > F.size(F.array_distinct(c["h"])))
    d = d.withColumn(n["s"], F.when(c["twice"], F.sort_array(F.transform(c["h"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(c["s"], lambda x, i: (x["h"] == F.get(c["s"], i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(c["s"], F.greatest(i - 1, F.lit(0)))["h"])))
    d = d.withColumn(n["p"], F.when(c["twice"], F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    out = d.withColumns(
        {
            "n_words": F.size(c["w"]).cast("long"),
            "word_chars": F.char_length(F.array_join(c["w"], "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
            "n_lines": F.size(c["lines"]).cast("long"),
            "n_repeat_words": F.when(c["twice"], F.size(F.array_distinct(c["p"]))).otherwise(0).cast("long"),
        }
    )
    return out.drop(*n.values())


def _features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = {
        "x_length": F.log1p("n_words"),
        "x_word": F.col("word_chars") / n,
        "x_symbols": F.log1p(10 * F.col("n_symbols") / n),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x_repeats": F.col("n_repeat_words") / n,
    }
    return stats.withColumns({k: F.round(v, 6) for k, v in values.items()})


def _quantiles(df: DataFrame, keys: list[str], value: str, share: float, width: float) -> DataFrame:
    """``keys, q``: upper edge of the bin in which the share of a group's values is reached.

    Bins are ``width`` wide, so that the result does not depend on the order of rows.
    """
    bins = df.groupBy(*keys, F.ceil(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    over = Window.partitionBy(*keys)
    run = bins.withColumn("upto", F.sum("n").over(over.orderBy("bin"))).withColumn("all", F.sum("n").over(over))
    return run.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg((F.min("bin") * width).alias("q"))


K, NAMES, FLOORS = range(len(FEATURES)), list(FEATURES), list(FEATURES.values())
LOWER = [(i, j) for i in K for j in range(i + 1)]
#: Columns of an estimate: mean, covariance, and the Cholesky factor of the covariance with the least variances added.
MEAN, COV, FACTOR = [f"m_{i}" for i in K], [f"c_{i}_{j}" for i, j in LOWER], [f"l_{i}_{j}" for i, j in LOWER]


def _factored(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """``df`` with the factor of its covariance, ``scale`` times, and ``logdet``."""
    for i, j in LOWER:
        own = scale * F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for t in range(j):
            own = own - F.col(f"l_{i}_{t}") * F.col(f"l_{j}_{t}")
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(own, F.lit(FLOORS[i] ** 2 / 4))) if i == j else own / F.col(f"l_{j}_{j}"))
    return df.withColumn("logdet", sum(2 * F.log(f"l_{i}_{i}") for i in K))


def _moments(df: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """``keys, n``, mean and covariance of ``values``, rounded so that the order of rows doesn't count."""
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.round(F.avg(v), 9).alias(m) for v, m in zip(values, MEAN, strict=True)], *[F.round(F.avg(values[i] * values[j]), 9).alias(f"c_{i}_{j}") for i, j in LOWER]
    )
    centred = {f"c_{i}_{j}": F.col(f"c_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") for i, j in LOWER}
    return sums.withColumns({c: F.greatest(F.lit(0.0), v) if c[2] == c[4] else v for c, v in centred.items()})


def _starts(points: DataFrame) -> DataFrame:
    """Three estimates of each ``pool``, by ``start``."""
    long = lambda df, of: df.select("pool", F.posexplode(F.array(*of)).alias("dim", "v"))
    wide = lambda df, stem: df.groupBy("pool").pivot("dim", list(K)).agg(F.first("q")).select("pool", *[F.col(str(i)).alias(f"{stem}_{i}") for i in K])
    medians = materialise(wide(_quantiles(long(points, [F.col(x) for x in NAMES]), ["pool", "dim"], "v", 0.5, 0.005), "q"), "medians")
    near = points.join(hinted(medians, 128), "pool")
    spread = _quantiles(long(near, [F.abs(F.col(x) - F.col(f"q_{i}")) for i, x in enumerate(NAMES)]), ["pool", "dim"], "v", 0.5, 0.005)
    scales = wide(spread, "s").select("pool", *[F.greatest(F.lit(f), 1.4826 * F.col(f"s_{i}")).alias(f"s_{i}") for i, f in enumerate(FLOORS)])
    robust = materialise(medians.join(scales, "pool"), "scales")
    q, s = [F.col(f"q_{i}") for i in K], [F.col(f"s_{i}") for i in K]
    plain = robust.select("pool", F.lit(0).alias("start"), *[q[i].alias(f"m_{i}") for i in K], *[(s[i] * s[i] if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in LOWER])
    classic = _moments(points, ["pool"], [F.col(x) for x in NAMES]).withColumn("start", F.lit(1))
    bent = _moments(points.join(hinted(robust, 192), "pool"), ["pool"], [F.tanh((F.col(x) - q[i]) / s[i]) for i, x in enumerate(NAMES)]).drop(*MEAN).join(robust, "pool")
    scale = [F.sqrt(F.greatest(F.col(f"c_{i}_{i}"), F.lit(1e-6))) for i in K]
    bent = bent.select("pool", F.lit(2).alias("start"), *[q[i].alias(f"m_{i}") for i in K], *[(s[i] * s[j] * F.col(f"c_{i}_{j}") / (scale[i] * scale[j])).alias(f"c_{i}_{j}") for i, j in LOWER])
    out = plain.unionByName(classic.drop("n")).unionByName(bent)
    return materialise(_factored(out.select("pool", "start", F.lit(0).cast("long").alias("n"), *MEAN, *COV)), "starts")


def _distance(points: DataFrame, estimate: DataFrame, *kept: str) -> DataFrame:
    """``points`` and ``kept`` with the squared distance ``d2``, by forward substitution in the Cholesky factor."""
    d = points.join(hinted(estimate.select("pool", *kept, *MEAN, *FACTOR), 320), "pool")
    for i, x in enumerate(NAMES):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        d = d.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return d.withColumn("d2", sum(F.col(f"y_{i}") * F.col(f"y_{i}") for i in K)).select(*points.columns, *kept, "d2")


def _concentrate(points: DataFrame, estimate: DataFrame) -> DataFrame:
    """New estimates from the documents nearest to each."""
    near = _distance(points, estimate, "start").withColumn("log_d2", F.log(F.col("d2") + 1e-9))
    limit = materialise(_quantiles(near, ["pool", "start"], "log_d2", SUPPORT, 0.01), "limits")
    core = near.join(hinted(limit, 64), ["pool", "start"]).where(F.ceil(F.col("log_d2") / 0.01) * 0.01 <= F.col("q") + 1e-6)
    return materialise(_factored(_moments(core, ["pool", "start"], [F.col(x) for x in NAMES])), "estimate")


def least_determinants(points: DataFrame) -> DataFrame:
    """For each ``pool``, the best of the estimates that concentration leads to."""
    now = _starts(points)
    for _ in range(TRIAL):
        now = _concentrate(points, now)
    cols = now.columns
    best = now.groupBy("pool").agg(F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("e")).select("e.*")
    best = materialise(best, "best")
    while True:  # determinants fall in each turn, and the least variances bound them below
        old, new = F.struct(*cols), F.col("new")
        joined = best.join(_concentrate(points, best).select("pool", F.struct(*cols).alias("new")), "pool")
        falls = joined.select(F.when(new["logdet"] < F.col("logdet") - SETTLED, new).otherwise(old).alias("e"), (new["logdet"] < F.col("logdet") - SETTLED).alias("fell"))
        falls = materialise(falls, "best")
        best = falls.select("e.*")
        if not falls.where("fell").limit(1).count():
            return best


def robust_distance(points: DataFrame) -> DataFrame:
    """``points`` (with ``lang, source`` and the features) with ``d2``."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    group = F.concat_ws("\n", text("lang"), text("source"))
    basis = points.select(F.explode(F.array(F.concat(F.lit("g"), group), F.concat(F.lit("l"), text("lang")))).alias("pool"), *FEATURES)
    found = least_determinants(materialise(basis, "basis"))
    sizes = materialise(points.groupBy(F.concat(F.lit("g"), group).alias("pool"), F.concat(F.lit("l"), text("lang")).alias("lang_")).agg(F.count("*").alias("size")), "sizes")
    lang = found.select(F.col("pool").alias("lang_"), *[F.col(c).alias(f"{c}_") for c in (*MEAN, *COV)])
    w = F.col("size") / (F.col("size") + SHRINK)
    both = sizes.join(found.select("pool", *MEAN, *COV), "pool").join(lang, "lang_")
    drawn = _factored(both.select("pool", *[(w * F.col(c) + (1 - w) * F.col(f"{c}_")).alias(c) for c in (*MEAN, *COV)]), CONSISTENCY)
    return _distance(points.withColumn("pool", F.concat(F.lit("g"), group)), materialise(drawn, "estimate")).drop("pool")


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document row: ``doc_id``, the base statistics, ``base_failed, d2, kept``."""
    return settled(docs.sparkSession, "judged", lambda: _judge(docs, cut))


def _judge(docs: DataFrame, cut: float) -> DataFrame:
    stats = base_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialise(_features(stats.withColumn("base_failed", failed)), "statistics")
    passed = robust_distance(stats.where(~F.col("base_failed")))
    out = passed.unionByName(stats.where("base_failed"), allowMissingColumns=True)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cut)).drop(*FEATURES)


def op5_quality_outliers(spark, sf_dir):
    """Base statistics and the verdict for every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("d2")
    )
