"""Quality rules with a robust multivariate outlier test, in DataFrame operations alone.

Per document: words, their characters, symbol characters, repeated lines and
words in repeated 8-word windows. Two base rules reject by these alone. The rest
are judged by the minimum-covariance-determinant method within their language
and source: the statistics are transformed to a vector; from several starts,
concentration steps look for the three quarters of a group whose covariance has
the smallest determinant, until it falls no more; a vector is rejected if its
Mahalanobis distance from there is beyond six deviations of the core.

Only deviations that mark bad text count: more symbols, more repetition, more
shouting than the group's core, or words much longer or shorter than its words.
Documents that are merely long or short aren't outliers.

Groups. A group with fewer than ``least_rows`` documents is judged with its
language, a language with fewer with all documents. Quantiles are percentile_approx
(mergeable and of bounded size), moments are sums, so a source with a third of
all rows is pre-aggregated in every task.

Defined results: null text has no words and fails the base rules; null language
and source are a group of their own; repeated rows count each; an empty table
gives no rows; columns of other names are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pick, scratch, written

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Share of a group that the core holds, starts, concentration steps at most, and the fall of a log determinant that counts as none.
CORE, STARTS, MOST_STEPS, LEAST_FALL = 0.75, 3, 12, 1e-3
ACCURACY = 1000
LEAST_ROWS = 60
#: Up to so many groups their figures are broadcast.
BROADCAST_GROUPS = 10_000
#: The transformed statistics and the standard deviation of the ridge of each.
VECTOR = {"x_symbols": 0.04, "x_lines": 0.12, "x_repeats": 0.15, "x_upper": 0.05, "x_length": 0.35}
#: Squared distance beyond which a vector is an outlier, in units of the core's: six deviations.
CUTOFF = 36.0


def word_array(text: Column) -> Column:
    """Words between the six space characters; none for null and blank texts."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang, source, the carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper."""
    own = ["doc_id", "lang", "source", *(carry or {})]
    one = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col, **(carry or {})).withColumn("text", F.coalesce("text", F.lit("")))
    one = one.select(*own, "text", word_array(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    one = one.select(
        *own,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[\p{Lu}!]")).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    one = one.select(
        *one.columns[:-2],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # only texts in which some window comes twice are sorted
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    one = one.select(*one.columns[:-1], F.when(again, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    twice = F.filter("s", lambda e, j: (F.get("s", j - 1)["x"] == e["x"]) | (F.coalesce(F.get("s", j + 1)["x"] == e["x"], F.lit(False))))
    one = one.select(*one.columns[:-1], F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"]))).alias("p"))
    covered = F.aggregate(F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), lambda b, a: F.least(F.lit(WINDOW), b - a)), F.lit(WINDOW), lambda total, x: total + x)
    return one.select(*one.columns[:-1], F.when(F.col("p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Rates under a square root, which steadies the spread of counts; the mean word length as it is."""

    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return stats.withColumns({
        "x_symbols": share("n_symbols", "word_chars"),
        "x_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
        "x_upper": share("n_upper", "word_chars"),
        "x_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    })


def _groups(table: DataFrame, least_rows: int) -> DataFrame:
    """g_lang, g_source -> g: the group that judges them."""
    sizes = table.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    langs = table.groupBy("g_lang").agg(F.count(F.lit(1)).alias("n_lang"))
    own = F.concat_ws("\x01", F.lit("s"), "g_lang", "g_source")
    return sizes.join(langs, "g_lang").select("g_lang", "g_source", F.when(F.col("n") >= least_rows, own).when(F.col("n_lang") >= least_rows, F.concat_ws("\x01", F.lit("l"), "g_lang")).otherwise("all").alias("g"))


def _each(small: DataFrame, few: bool) -> DataFrame:
    """A table with a few rows a group, broadcast if there are few groups."""
    return F.broadcast(small) if few else small


def _shapes(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, m_i, the lower Cholesky factor l_i_j of each group's covariance, and its log determinant.

    The covariance has one ridge: the squares of VECTOR on its diagonal, so a group
    whose rows are all alike still has a scatter.
    """
    dims, ridge = list(VECTOR), [x**2 for x in VECTOR.values()]
    pairs = [(i, j) for i in range(len(dims)) for j in range(i + 1)]
    got = rows.groupBy(*by).agg(*[F.avg(d).alias(f"m_{i}") for i, d in enumerate(dims)], *[F.avg(F.col(dims[i]) * F.col(dims[j])).alias(f"p_{i}_{j}") for i, j in pairs])
    cov = {(i, j): F.col(f"p_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") for i, j in pairs}
    out = got.select(*by, *[f"m_{i}" for i in range(len(dims))], *[(F.greatest(cov[i, i], F.lit(0.0)) + ridge[i] if i == j else cov[i, j]).alias(f"c_{i}_{j}") for i, j in pairs])
    for j in range(len(dims)):  # column by column
        done = reduce(lambda a, b: a + b, [F.col(f"l_{j}_{k}") ** 2 for k in range(j)], F.lit(0.0))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - done, F.lit(1e-12))))  # against rounding alone
        below = {}
        for i in range(j + 1, len(dims)):
            cross = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            below[f"l_{i}_{j}"] = (F.col(f"c_{i}_{j}") - cross) / F.col(f"l_{j}_{j}")
        out = out.withColumns(below) if below else out
    log_det = reduce(lambda a, b: a + b, [2 * F.log(f"l_{i}_{i}") for i in range(len(dims))])
    return out.select(*by, *_shape_columns(), log_det.alias("log_det"))


def _shape_columns() -> list[str]:
    n = len(VECTOR)
    return [f"m_{i}" for i in range(n)] + [f"l_{i}_{j}" for i in range(n) for j in range(i + 1)]


def _distance(dims: list[str], one_sided: bool) -> list[tuple[str, Column]]:
    """Steps of the forward substitution L y = x - m; the last column is the squared distance d2.

    one_sided: deviations of the rates below the core count as none.
    """
    steps = []
    for i, d in enumerate(dims):
        off = F.col(d) - F.col(f"m_{i}")
        if one_sided and d != "x_length":
            off = F.greatest(off, F.lit(0.0))
        known = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)], F.lit(0.0))
        steps.append((f"y_{i}", (off - known) / F.col(f"l_{i}_{i}")))
    steps.append(("d2", reduce(lambda a, b: a + b, [F.col(f"y_{i}") ** 2 for i in range(len(dims))])))
    return steps


def _measured(rows: DataFrame, shape: DataFrame, by: list[str], few: bool) -> DataFrame:
    """rows, for each shape of their group, with by and the squared distance d2."""
    out = rows.join(_each(shape, few), "g")
    for name, value in _distance(list(VECTOR), one_sided=False):
        out = out.withColumn(name, value)
    return out.select(*by, *VECTOR, "d2")


def _concentrated(measured: DataFrame, by: list[str], core: float, few: bool) -> DataFrame:
    """A concentration step: the shapes of the core, the nearest rows of each group."""
    cut = measured.groupBy(*by).agg(F.percentile_approx("d2", core, ACCURACY).alias("cut"))
    return _shapes(measured.join(_each(cut, few), by).where("d2 <= cut"), by)


def _starts(rows: DataFrame, core: float, few: bool) -> DataFrame:
    """g, s and shapes: of the rows next to the median, and of two tenths dealt by their values (none for a tenth without rows)."""
    dims = list(VECTOR)
    medians = rows.groupBy("g").agg(*[F.percentile_approx(d, 0.5, ACCURACY).alias(f"m_{i}") for i, d in enumerate(dims)])
    off = reduce(lambda a, b: a + b, [((F.col(d) - F.col(f"m_{i}")) / VECTOR[d]) ** 2 for i, d in enumerate(dims)])
    near = rows.join(_each(medians, few), "g").withColumn("d2", off).select("g", F.lit(0).alias("s"), *dims, "d2")
    tenth = F.pmod(F.xxhash64(*dims), F.lit(10)).cast("int")
    tenths = rows.withColumn("s", tenth).where(F.col("s").between(1, STARTS - 1))
    return _concentrated(near, ["g", "s"], core, few).unionByName(_shapes(tenths, ["g", "s"]))


def outlier_shapes(rows: DataFrame, core: float = CORE, most_steps: int = MOST_STEPS, few: bool = True) -> DataFrame:
    """g, m_*, l_*, scale: location and Cholesky factor of the smallest determinant found, and the consistency factor of its distances.

    Every start takes two concentration steps; the one with the smallest
    determinant goes on until no group's determinant falls any more. A step costs
    two passes over the narrow vectors, pre-aggregated in every task. few: there
    are few enough groups to broadcast their figures.
    """
    spark, by = rows.sparkSession, ["g", "s"]
    shape = written(_starts(rows, core, few), scratch(spark, "shape"))
    for _ in range(2):
        shape = written(_concentrated(_measured(rows, shape, by, few), by, core, few), scratch(spark, "shape"))
    best = F.min(F.struct("log_det", "s", *_shape_columns())).alias("best")
    shape = shape.groupBy("g").agg(best).select("g", "best.log_det", *[f"best.{c}" for c in _shape_columns()])
    for _ in range(most_steps - 2):
        before = shape.select("g", F.col("log_det").alias("before"))
        shape = written(_concentrated(_measured(rows, shape, ["g"], few), ["g"], core, few).join(_each(before, few), "g"), scratch(spark, "shape"))
        fallen = shape.agg(F.max(F.col("before") - F.col("log_det")).alias("x")).first()["x"]
        shape = shape.drop("before")
        if fallen is None or fallen < LEAST_FALL:
            break
    # distances are scaled so that their median is that of the chi-square law, never down
    p = len(VECTOR)
    median = p * (1 - 2 / (9 * p)) ** 3
    scale = _measured(rows, shape, ["g"], few).groupBy("g").agg(F.greatest(F.percentile_approx("d2", 0.5, ACCURACY) / F.lit(median), F.lit(1.0)).alias("scale"))
    return shape.drop("log_det").join(scale, "g")


def _keyed(stats: DataFrame) -> DataFrame:
    """The statistics with the vector, the base verdict and null-safe group columns."""

    def named(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    return vectors(stats).withColumns({"g_lang": named("lang"), "g_source": named("source"), "base_failed": base_failed()})


def _fitted(table: DataFrame, least_rows: int) -> tuple[DataFrame, bool]:
    """g_lang, g_source with the location, Cholesky factor and scale that judge them: a row for each language and source; and whether those are few."""
    spark = table.sparkSession
    sound = table.where(~F.col("base_failed"))
    groups = written(_groups(sound, least_rows), scratch(spark, "groups"))
    few = groups.count() <= BROADCAST_GROUPS
    rows = sound.join(_each(groups, few), ["g_lang", "g_source"]).select("g", *VECTOR)
    return written(groups.join(outlier_shapes(rows, few=few), "g").drop("g"), scratch(spark, "fitted")), few


def _judged(table: DataFrame, fitted: DataFrame, few: bool, cutoff: float) -> DataFrame:
    """The table with distance and kept."""
    out = table.join(_each(fitted, few), ["g_lang", "g_source"], "left")  # groups whose rows all fail the base rules have no shape
    for name, value in _distance(list(VECTOR), one_sided=True):
        out = out.withColumn(name, value)
    distance = F.when(~F.col("base_failed"), F.sqrt(F.col("d2") / F.col("scale")))
    return out.select(*table.columns, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff * F.col("scale"), F.lit(False))).alias("kept"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The statistics of every row, base_failed, distance (null if the base rules failed) and kept."""
    table = written(_keyed(statistics(docs, id_col, text_col, lang_col, source_col)), scratch(docs.sparkSession, "statistics"))
    found = _judged(table, *_fitted(table, least_rows), cutoff)
    return found.drop("g_lang", "g_source", *VECTOR)


def keep_sound(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that judge keeps, all columns as they are. The texts are read and written once and not shuffled."""
    carry = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    table = written(_keyed(statistics(docs, id_col, text_col, lang_col, source_col, carry)), scratch(docs.sparkSession, "statistics"))
    found = _judged(table, *_fitted(table.drop(*carry), least_rows), cutoff)
    return found.where("kept").select(*[F.col(k).alias(c) for k, c in carry.items()])
