"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Measures per document feed one-sided rules (value above or below a cutoff rejects), each with cutoffs from lax to
strict. A policy of strictness i rejects what any rule rejects at its cutoff i, so that policies are nested and a
document is described by the least strictness that rejects it. For every stratum the policies are tested on the labelled
documents from lax to strict: k of n good ones would be rejected, and the exact binomial tail P(Bin(n, risk) <= k) is
the p-value of "this policy rejects more than `risk` of the good". Testing in a fixed order ends at the first policy that
fails and needs no correction within a stratum (k, and with it the p-value, never falls). Over strata `delta` is shared
in proportion to their numbers of good labels (weighted Bonferroni), so that no stratum loses more than `risk` of its
good documents, all strata at once, with probability 1 - delta. Of the certified policies the one that rejects most bad
documents is used, the laxest on ties, and none where no bad document is rejected.

Defined cases: a null text has no words and fails the base rule; a null stratum is a stratum of its own; repeated rows
each get their own result; repeated labels of a document count once (the lowest quality); labels that are neither 0 nor
1 and documents without label don't count; without labels nothing is certified and the base rule alone decides. A very
long text is measured whole, in one row. Result columns whose names clash with kept ones get a prefix (see named()).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, small_or_shuffled, stored, table, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
#: rule: (measure, rejects above the cutoff?, cutoffs from lax to strict)
RULES: dict[str, tuple[str, bool, tuple[float, ...]]] = {
    "symbols": ("symbol_ratio", True, (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "dup_lines": ("dup_line_ratio", True, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeats": ("repeat_ratio", True, (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "capitals": ("upper_ratio", True, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "marks": ("mark_ratio", True, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "long_words": ("mean_word", True, (20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("mean_word", False, (1.5, 2.0, 2.5, 3.0, 3.5, 4.0)),
}
STEPS = max(len(grid) for *_, grid in RULES.values())
#: Strata up to this number are broadcast with their cutoffs; more are joined by a shuffle.
BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Risk:
    risk: float = 0.02
    delta: float = 0.05


def neighbours(values: Column, of) -> Column:
    """of(a, b) for each element and its successor."""
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), of))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep`, and the counts of each whole text.

    A word's place counts as repeated if one of the 3-word windows over it is found twice or more in the text; windows
    are compared by 64-bit hashes of their words' 64-bit hashes, within one document.
    """
    text = F.col("_text")
    length = F.length(text)

    def without(chars: str) -> Column:
        return length - F.length(F.translate(text, chars, ""))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = docs.select(*keep, text_or_empty().alias("_text")).select(
        *keep,
        (length - without(SPACES)).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]", "")).cast("long").alias("n_upper"),
        without("!?").cast("long").alias("n_marks"),
        lines.alias("_lines"),
        F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), lambda w: F.xxhash64(w)).alias("_words"),
    )
    n = F.size("_words")
    pairs = F.zip_with(F.slice("_words", F.lit(1), n - 2), F.slice("_words", F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.when(n > 2, F.zip_with(pairs, F.slice("_words", F.lit(3), n - 2), lambda a, b: F.xxhash64(a, b)))
    df = df.select(
        *keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_marks",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_sorted"),
    )
    same = neighbours(F.col("_sorted"), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(same)))).drop("_sorted")
    covered = F.aggregate(neighbours(F.col("_at"), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda s, x: s + x)
    repeated = F.when(F.size("_at") > 1, covered).otherwise(0)
    return df.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("_at")


def ratios() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "upper_ratio": F.col("n_upper") / chars,
        "mark_ratio": F.col("n_marks") / words,
        "mean_word": F.col("word_chars") / words,
    }


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0 to about 1e-12: Stirling's series at x + 8, carried down."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    down = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): the term at k, times the sum of the terms' ratios below it.

    After 5000 terms the rest is bounded by its geometric series, which can only make the bound more careful.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(5000.0)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), k.alias("k"), n.alias("n"))

    def step(s: Column, _: Column) -> Column:
        ratio = s.k / (s.n - s.k + 1) * ((1 - p) / p)
        return F.struct((s.term * ratio).alias("term"), (s.sum + s.term).alias("sum"), (s.k - 1).alias("k"), s.n.alias("n"))

    ratio = F.greatest(k - 5001, F.lit(0.0)) / (n - k + 5002) * ((1 - p) / p)
    whole = F.aggregate(steps, start, step, lambda s: s.sum + F.when(k > 5000, s.term / (1 - F.least(ratio, F.lit(0.999999)))).otherwise(0.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * whole)


def strictness(rule: str) -> Column:
    """The place of the first cutoff of a rule's grid that rejects; null if none does."""
    m, above, grid = RULES[rule]
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(grid))):
        out = F.when(F.col(m) > c if above else F.col(m) < c, i).otherwise(out)
    return out


def thresholds(values: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, step, n, k, caught, p_value) of the policies in use; values: doc_id, stratum, base_failed, least (strictness that rejects)."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good, rejects = F.col("quality") == 1, F.coalesce(F.col("least") <= F.col("step"), F.lit(False))
    tests = values.where("not base_failed").join(labels, "doc_id").select("stratum", "quality", "least", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    counted = tests.groupBy("stratum", "step").agg(F.count_if(good).alias("n"), F.count_if(good & rejects).alias("k"), F.count_if(~good & rejects).alias("caught"))
    counted = stored(counted, "policies")
    labelled = counted.where("step = 0").agg(F.sum("n")).first()[0] or 1
    tested = counted.where("n > 0").withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), risk.risk))
    chosen = tested.where((F.col("p_value") <= risk.delta * F.col("n") / labelled) & (F.col("caught") > 0))
    best = chosen.groupBy("stratum").agg(F.max_by(F.struct("step", "n", "k", "caught", "p_value"), F.struct("caught", -F.col("step"))).alias("b"))
    return best.select("stratum", "b.*")


def named(column: str, keep: list[str]) -> str:
    """The name of a result's column beside those kept: another one where it would clash."""
    taken = {c.lower() for c in keep}
    while column in taken:
        column = f"quality_{column}"
    return column


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The columns of `keep`, the measures, base_failed, and kept: false if base_failed, or if a rule in use rejects."""
    inner = {"_id": F.col("doc_id"), "_stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))}
    rows = docs.withColumns(inner | {f"_k{i}": F.col(f"`{c}`") for i, c in enumerate(keep)})
    rows = measured(rows, [*inner, *(f"_k{i}" for i in range(len(keep)))])
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = stored(rows, "quality")
    measures = rows.select("*", *(c.alias(m) for m, c in ratios().items()))
    each = {r: strictness(r) for r in RULES}
    values = measures.select(F.col("_id").alias("doc_id"), F.col("_stratum").alias("stratum"), "base_failed", F.least(*each.values()).alias("least"))
    cuts = stored(thresholds(values, labels.select("doc_id", "quality"), risk), "thresholds").select("stratum", F.col("step").alias("_step"))
    rule = F.when(F.col("base_failed"), "base")
    for r, x in each.items():
        rule = rule.when(x <= F.col("_step"), r)
    rows = measures.join(small_or_shuffled(cuts, BROADCAST_STRATA), measures["_stratum"] == cuts["stratum"], "left")
    out = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
    out |= {"kept": F.col("_rule").isNull(), "rejected_by": F.col("_rule")}
    return rows.withColumn("_rule", rule).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *(x.alias(named(c, keep)) for c, x in out.items()))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: every document's measures and verdict."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def rejecting(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the rest stay as they are."""
    rows = judged(docs, table(spark, sf_dir, "labels"), docs.columns)
    return rows.where(F.col(f"`{named('kept', docs.columns)}`")).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(risk: Risk = Risk()) -> str:
    """The query's result in SQL, thresholds included."""
    def least(m: str, above: bool, grid: tuple[float, ...]) -> str:
        return "case " + " ".join(f"when {m} {'>' if above else '<'} {c}::double then {i}" for i, c in enumerate(grid)) + " end"

    each = ", ".join(f"{least(*x)} as least_{r}" for r, x in RULES.items())
    first = " ".join(f"when least_{r} <= step then '{r}'" for r in RULES)
    p = risk.risk
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, chr(1)) as stratum, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
r as (select rid, count(distinct k) as n from (select rid, unnest([i, i + 1, i + 2]) as k from (select rid, i, count(*) over (partition by rid, gram) as c from g) where c > 1) group by rid),
m as (select w.rid, doc_id, stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols,
    length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as n_upper, length(t) - length(translate(t, '!?', '')) as n_marks, len(lines) as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r on w.rid = r.rid),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols::double / greatest(word_chars, 1) as symbol_ratio, n_dup_lines::double / greatest(n_lines, 1) as dup_line_ratio,
    n_repeat_words::double / greatest(n_words, 1) as repeat_ratio, n_upper::double / greatest(word_chars, 1) as upper_ratio, n_marks::double / greatest(n_words, 1) as mark_ratio, word_chars::double / greatest(n_words, 1) as mean_word from m),
q as (select doc_id, min(quality) as quality from labels where quality in (0, 1) and doc_id is not null group by doc_id),
l as (select *, {each} from v),
c as (select stratum, step, quality, coalesce(least({", ".join(f"least_{r}" for r in RULES)}) <= step, false) as rejects
  from l join q using (doc_id), range({STEPS}) as x(step) where not base_failed),
k as (select stratum, step, count(*) filter (where quality = 1) as n, count(*) filter (where quality = 1 and rejects) as k, count(*) filter (where quality = 0 and rejects) as caught from c group by all),
p as (select *, (select sum(n) from k where step = 0) as labelled,
    case when k >= n * {p!r}::double then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}::double) + (n - i) * ln(1 - {p!r}::double)))) end as p_value from k where n > 0),
b as (select stratum, step, row_number() over (partition by stratum order by caught desc, step) as place from p where p_value <= {risk.delta!r}::double * n / labelled and caught > 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by is null as kept, rejected_by
from (select l.*, case when base_failed then 'base' {first} end as rejected_by from l left join b on l.stratum = b.stratum and b.place = 1)
"""
