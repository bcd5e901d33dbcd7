"""Quality rules: robust multivariate outliers by the minimum covariance determinant (operator 5).

Base rules are counts within a text.  The method judges a text by a vector of transformed statistics
(DIMENSIONS), against the texts of its language and source: the minimum-covariance-determinant estimate
is the mean and covariance of the SUPPORT share of them that lies closest together, reached by
STEPS concentration steps (distances, the closest share, its mean and covariance, again) from one robust
start, the medians and median absolute deviations.  SUPPORT is half, so junk may be nearly half of a group
without hiding itself.  A text goes where its squared Mahalanobis distance exceeds CUTOFF.

Everything is DataFrame operations.  Statistics are fixed-point integers (SCALE units), so sums,
products and thresholds are exact and do not depend on the order of rows.  A concentration step is one
pass: counts and moments by group and bin of the distance, combined before the shuffle, of which the
closest bins add up to the next estimate; so a source with a third of all rows costs some partial sums
for each task, and no group is ever gathered.  What is joined back to the rows is
one line of parameters for each group, broadcast only while there are at most BROADCAST_GROUPS of them.
Groups of fewer than MIN_GROUP texts are judged by the estimate from all texts of their language, or, where
those are fewer too, from all texts.

Edge cases: null and empty texts have no words and fail the base rule; a text of any length is one row;
null lang or source are a group of their own; equal rows have equal statistics, and a group of nothing
but equal rows has the ridge FLOOR as its covariance and keeps them; an empty table gives no rows.
Columns of the input with the names of the result are the caller's matter: ``judge`` carries only the
columns named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

MIN_WORDS, MAX_REPEATED = 50, 0.5
SCALE, BINS = 1024, 32
SUPPORT, STEPS, CUTOFF, MIN_GROUP, BROADCAST_GROUPS = 0.5, 6, 60.0, 50, 20_000
#: Names of the transformed statistics and the least standard deviation that each is granted.
DIMENSIONS = {"x_length": 0.30, "x_word": 0.10, "x_symbols": 0.35, "x_lines": 0.35, "x_repeats": 0.35}
#: Mean of the squared distance of the closest SUPPORT share of a normal sample in five dimensions, over 5: makes the estimate consistent.
_CONSISTENCY = 0.5230
_SPACE, _TEXT = r"[ \t\n\x0B\f\r]+", " \t\n\x0b\f\r"


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words within runs of three that occur twice or more.  Places are sorted by the run's hash, so the cost
    is n log n for any text; without two equal hashes there is nothing to sort."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def count(h: Column) -> Column:
            def of_sorted(s: Column) -> Column:
                again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
                return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

            pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bound(F.sort_array(pairs), of_sorted))

        return _bound(runs, count)

    return F.when(F.size(words) < 4, 0).otherwise(_bound(words, of)).cast("bigint")


def statistics(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry and, for each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim(t, F.lit(_TEXT))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))
    first = docs.select(*carry, t.alias("__t"), words.alias("__w"))
    n = F.size("__w").cast("bigint")
    rows = first.select(
        *carry, n.alias("n_words"), F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        _bound(lines_of("__t"), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
        F.size(lines_of("__t")).cast("bigint").alias("__lines"), _repeated(F.col("__w")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MAX_REPEATED)))


def lines_of(text: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_TEXT)) != "")


def _vector(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = {
        "x_length": F.log1p("n_words"),
        "x_word": F.log1p(F.col("word_chars") / n),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "x_lines": F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))),
        "x_repeats": F.log1p(10 * F.col("n_repeat_words") / n),
    }
    return rows.withColumns({k: F.round(v * SCALE).cast("bigint") for k, v in x.items()})


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the parameters' Cholesky factor."""
    y: list[Column] = []
    for i, a in enumerate(names):
        rest = F.col(a) / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _moments(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Exact sums of the vectors and their products, for each group."""
    sums = [F.sum(F.col(a)).alias(f"s{i}") for i, a in enumerate(names)]
    products = [F.sum((F.col(a) * F.col(names[j])).cast("decimal(20,0)")).alias(f"p{i}{j}") for i, a in enumerate(names) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _closest(binned: DataFrame, names: list[str]) -> DataFrame:
    """Moments of each group's closest bins: those that begin below the SUPPORT share.  A group has at most some
    hundred bins, whatever its size, so its window is short."""
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    close = binned.withColumn("before", before).withColumn("total", F.sum("n").over(group)).where(F.col("before") < F.col("total") * SUPPORT)
    sums = [f"s{i}" for i in range(len(names))] + [f"p{i}{j}" for i in range(len(names)) for j in range(i + 1)]
    return close.groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))


def _parameters(moments: DataFrame, keys: list[str], names: list[str], factor: float) -> DataFrame:
    """Mean and lower Cholesky factor of covariance / factor plus the ridge, for each group."""
    n, d = F.col("n"), len(names)
    floor = list(DIMENSIONS.values())
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / n / SCALE for i in range(d)})
    out = out.withColumns({f"c{i}{j}": F.col(f"p{i}{j}").cast("double") / n / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}") for i in range(d) for j in range(i + 1)})
    for j in range(d):
        new = {}
        for i in range(j, d):
            v = F.col(f"c{i}{j}") / factor + (floor[j] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            new[i] = v
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(new[j], F.lit(1e-9))))
        out = out.withColumns({f"l{i}{j}": new[i] / F.col(f"l{j}{j}") for i in range(j + 1, d)})
    return out.select(*keys, *(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i in range(d) for j in range(i + 1)))


def _median(vectors: DataFrame, names: list[str]) -> DataFrame:
    """The start: each group's medians, and as spread the median absolute deviation, from counts of rounded values."""
    long = vectors.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("d"), F.floor(F.col(a) / 16).alias("v")) for i, a in enumerate(names)))).alias("x")).select("g", "x.d", "x.v")
    counts = long.groupBy("g", "d", "v").count()

    def middle(rows: DataFrame, value: str, name: str) -> DataFrame:
        total = rows.groupBy("g", "d").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct(value, "count"))).alias("bins"))
        half = F.aggregate("bins", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")), lambda a, x: F.struct((a["seen"] + x["count"]).alias("seen"), F.when(a["at"].isNull() & (2 * (a["seen"] + x["count"]) >= F.col("total")), x[value]).otherwise(a["at"]).alias("at")))
        return total.select("g", "d", half["at"].alias(name))

    mid = middle(counts, "v", "mid")
    off = counts.join(mid, ["g", "d"]).withColumn("off", F.abs(F.col("v") - F.col("mid"))).groupBy("g", "d", "off").agg(F.sum("count").alias("count"))
    both = mid.join(middle(off, "off", "mad"), ["g", "d"])
    floor = list(DIMENSIONS.values())
    return both.groupBy("g").agg(*(F.max(F.when(F.col("d") == i, (F.col("mid") + 0.5) * 16 / SCALE)).alias(f"m{i}") for i in range(len(names))), *((F.max(F.when(F.col("d") == i, F.sqrt((F.col("mad") * 16 / SCALE * 1.4826) ** 2 + floor[i] ** 2))) if i == j else F.max(F.lit(0.0))).alias(f"l{i}{j}") for i in range(len(names)) for j in range(i + 1)))


def judge(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept."""
    names = list(DIMENSIONS)
    extra = [c for c in (lang, source) if c not in carry]
    rows = _vector(statistics(docs, [*carry, *extra], text))
    rows = common.keep(rows, "statistics")
    usable = rows.where(~F.col("base_failed"))
    # a group too small to judge by borrows from its language, then from all texts
    pair = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("+"), F.col(lang)), F.lit("-")), F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit("-")))
    own = F.coalesce(F.concat(F.lit("+"), F.col(lang)), F.lit("-"))
    sizes = usable.groupBy(pair.alias("pair"), own.alias("own")).count()
    by_lang = sizes.groupBy("own").agg(F.sum("count").alias("of_lang"))
    groups = sizes.join(by_lang, "own").select("pair", F.when(F.col("count") >= MIN_GROUP, F.concat(F.lit("p"), "pair")).when(F.col("of_lang") >= MIN_GROUP, F.concat(F.lit("l"), "own")).otherwise("all").alias("g"))
    groups = common.keep(groups, "groups")
    small = groups.count() <= BROADCAST_GROUPS

    def attach(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on, how)

    # a text counts wherever one is judged: in its pair, and in its language and in all if a small pair borrows from them
    judging = groups.select("g").distinct()
    feeds = sizes.select("pair", F.explode(F.array(F.concat(F.lit("p"), "pair"), F.concat(F.lit("l"), "own"), F.lit("all"))).alias("g")).join(judging, "g")
    feeds = common.keep(feeds, "feeds")
    vectors = attach(usable.select(pair.alias("pair"), *names), feeds, "pair").select("g", *names)
    parameters = common.keep(_median(vectors, names), "start")
    for _ in range(STEPS):
        near = attach(vectors, parameters, "g").select("g", *names, F.floor(F.log1p(_distance(names)) * BINS).cast("int").alias("bin"))
        parameters = common.keep(_parameters(_closest(_moments(near, ["g", "bin"], names), names), ["g"], names, _CONSISTENCY), "step")
    judged = attach(attach(rows.withColumn("pair", pair), groups, "pair", "left"), parameters, "g", "left")
    distance = F.when(F.col("base_failed"), None).otherwise(_distance(names))
    return judged.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject."""
    prefix = "__doc_"
    inner = docs.select(*(F.col(f"`{c}`").alias(prefix + c) for c in docs.columns))
    judged = judge(inner, inner.columns, prefix + "text", prefix + "lang", prefix + "source")
    return judged.where("kept").select(*(F.col(f"`{prefix}{c}`").alias(c) for c in docs.columns))
