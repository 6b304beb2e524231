"""Quality rules: weak supervision instead of an all-must-pass filter.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or
abstains (0). A latent class explains the votes: a document is good, or bad in
one of several ways, the rules that know a kind of junk by itself (symbols,
capitals, ..); the others are evidence that no document is bad by alone. Each
class has its own distribution over every rule's three votes. Expectation
maximisation learns these distributions (the rules' accuracies) and the shares
of the classes from the votes alone; a document's posterior probability of being
good follows. So a rule that errs on good documents is overruled by the others,
and documents that no rule votes against go if the votes, abstentions among
them, are those of junk.

Votes are reduced to counts per vote pattern (at most 3 ** rules rows whatever
the corpus holds), so that EM is one fold over a single row; all of it is SQL
expressions in the JVM. Texts are read once: their statistics, a few numbers a
document, are staged.

Null and empty texts have no words; their statistics are 0, and the rules that
divide by the number of words vote on 0 <= 0. Texts are read whole, however long.
Rows that repeat are documents of their own and count each. Columns named like
results are replaced, others carried. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANK_CHARS, BLANKS, keyed_lookup, stage

#: (name, bad if, good if, whether it knows a kind of junk by itself); the first condition that holds decides, else the rule abstains.
RULES = (
    ("length", "n_words < 10", "n_words >= 10", True),
    ("symbols", "n_symbols > 0.2 * n_words", "n_symbols <= 0.02 * n_words", True),
    ("capitals", "n_capitals > 0.25 * word_chars", "n_capitals <= 0.08 * word_chars", True),
    ("repeats", "n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.2 * n_words", True),
    ("lines", "n_dup_lines > 0.2 * n_lines", "n_dup_lines = 0", False),
    ("word_length", "word_chars < 3 * n_words or word_chars > 7 * n_words", "word_chars between 4.6 * n_words and 6 * n_words", False),
)
#: Where EM starts: a rule's votes (bad, abstain, good) on good documents, on junk that it knows, on other junk; the share of good ones.
ON_GOOD, ON_OWN, ON_OTHER, GOOD = (0.01, 0.09, 0.9), (0.8, 0.15, 0.05), (0.2, 0.3, 0.5), 0.9
#: The start counts as so many documents a class, a weak prior.
PRIOR_DOCUMENTS = 8.0
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(word_list: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that a text has twice or more, the first included.

    A window is the 64-bit hash of its words' hashes. Only a text whose windows
    are not all different sorts them: equal neighbours mark places, and the
    places' windows are united, each adding at most its distance to the one before.
    """

    def windows(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))
        return F.slice(at, 1, F.size(h) - (window - 1))

    def marked(s: Column) -> Column:
        none, hashes = F.array(F.lit(None).cast("long")), s.getField("w")
        before = F.concat(none, F.slice(hashes, 1, F.size(s) - 1))
        after = F.concat(F.slice(hashes, 2, F.size(s)), none)
        sides = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        both = F.zip_with(s, sides, lambda x, y: F.when((x["w"] == y["b"]) | (x["w"] == y["a"]), x["i"]))
        return F.sort_array(F.filter(both, lambda i: i.isNotNull()))

    def united(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    def counted(k: Column) -> Column:
        ordered = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(let(let(ordered, marked), united))

    hashes = F.transform(word_list, lambda x: F.xxhash64(x))
    return F.when(F.size(word_list) <= window, 0).otherwise(let(let(hashes, windows), counted))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words (longs)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    of_words = let(
        F.array_remove(F.split(t, BLANKS), ""),
        lambda w: F.struct(
            F.size(w).alias("n"),
            repeated_words(w).alias("repeat"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = docs.withColumns({"__w": of_words, "__l": of_lines})
    numbers = {
        "n_words": F.col("__w.n"),
        "word_chars": F.length(F.translate(t, BLANK_CHARS, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
        "n_capitals": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")),
        "n_lines": F.col("__l.n"),
        "n_dup_lines": F.col("__l.dup"),
        "n_repeat_words": F.col("__w.repeat"),
    }
    return out.withColumns({k: v.cast("long") for k, v in numbers.items()}).drop("__w", "__l")


def votes(stats: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``votes``, an array with -1, 0 or 1 for each rule."""
    return stats.withColumn("votes", F.array(*[F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for _, bad, good, _ in rules]))


def beginning(rules=RULES) -> list[float]:
    """The parameters EM starts from: the share of each class, good first, then P(vote | class) by class, rule and vote (-1, 0, 1)."""
    kinds = [j for j, r in enumerate(rules) if r[3]]
    out = [GOOD, *[(1 - GOOD) / len(kinds)] * len(kinds)]
    for kind in [None, *kinds]:
        for j in range(len(rules)):
            out += ON_GOOD if kind is None else ON_OWN if kind == j else ON_OTHER
    return out


def fit(patterns: DataFrame, rules=RULES, rounds: int = 40) -> DataFrame:
    """EM over (votes, n), one row per vote pattern; adds ``posterior``, the probability of good.

    The parameters are one array, as ``beginning`` has them. All patterns meet in
    one row, of which there are 3 ** rules at most.
    """
    m, first = len(rules), beginning(rules)
    k = len(first) // (1 + 3 * m)
    start = f"array({', '.join(f'{x!r}D' for x in first)})"

    def let_sql(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def shares(v: str, th: str) -> str:
        """P(class | votes) of every class."""
        each = f"transform(sequence(0, {k - 1}), c -> aggregate(sequence(0, {m - 1}), ln({th}[c]), (s, j) -> s + ln({th}[{k} + (c * {m} + j) * 3 + {v}[j] + 1])))"
        odds = let_sql("ls", each, "transform(ls, x -> exp(x - array_max(ls)))")
        return let_sql("os", odds, "transform(os, x -> x / aggregate(os, 0D, (s, y) -> s + y))")

    mass = "aggregate(e, 0D, (s, x) -> s + x.n * x.p[{c}])"
    voted = f"aggregate(e, 0D, (s, x) -> s + if(x.v[((i - {k}) div 3) % {m}] = (i - {k}) % 3 - 1, x.n * x.p[{{c}}], 0D))"
    of = f"cast((i - {k}) div {3 * m} as int)"
    share = f"({mass.format(c='i')} + {PRIOR_DOCUMENTS}D * t0[i]) / (aggregate(e, 0D, (s, x) -> s + x.n) + {PRIOR_DOCUMENTS}D)"
    vote = f"({voted.format(c=of)} + {PRIOR_DOCUMENTS}D * t0[i]) / ({mass.format(c=of)} + {PRIOR_DOCUMENTS}D)"
    expect = f"transform(ps, r -> named_struct('v', r.v, 'n', r.n, 'p', {shares('r.v', 'th')}))"
    step = let_sql("e", expect, f"transform(sequence(0, {len(first) - 1}), i -> if(i < {k}, {share}, {vote}))")
    row = patterns.agg(F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("ps"))
    learnt = row.withColumn("t0", F.expr(start)).withColumn("th", F.expr(f"aggregate(sequence(1, {rounds}), t0, (th, round) -> {step})"))
    each = learnt.selectExpr("th", "explode(ps) as r")
    return each.selectExpr("r.v as votes", "cast(r.n as long) as n", f"{shares('r.v', 'th')}[0] as posterior")


def judge(docs: DataFrame, text: str = "text", rules=RULES, rounds: int = 40, keep_at: float = 0.5) -> DataFrame:
    """The statistics, ``votes``, ``posterior`` and ``kept`` of each row, with all other columns but the text.

    They replace columns of such names.
    """
    kept = [c for c in docs.columns if c not in (text, "posterior", "kept")]
    stats = stage(votes(statistics(docs.select(*kept, text), text).drop(text), rules), "quality")
    learnt = fit(stats.groupBy("votes").agg(F.count("*").alias("n")), rules, rounds)
    return keyed_lookup(stats, learnt, "votes").withColumn("kept", F.col("posterior") >= keep_at)


def op1(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )
