"""Quality rules: base statistics of a text and a decision list learned by sequential covering.

The statistics are DataFrame expressions over one row, without a shuffle; the time is linear in the text but for one
sort of 8-byte integers. The learner grows one conjunction of thresholds at a time on labelled statistics by FOIL's
gain, prunes it on rows that it wasn't grown on, removes what it covers, and repeats. The result is an ordered list of
Spark conditions, readable as text."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import bounded_sample, words

SYMBOLS = r"[#*$%&|<>]"
#: What rules compare: integers, so that thresholds are exact. Per mille of words, lines or characters.
FEATURES = {
    "symbols": "n_symbols * 1000 div greatest(n_words, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 100 div greatest(n_words, 1)",
    "capitals": "n_capitals * 1000 div greatest(word_chars, 1)",
    "marks": "n_marks * 1000 div greatest(n_words, 1)",
}

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")

# Windows of three words are 64-bit hashes whose low bits give way to the window's position; after a sort, equal hashes
# stand side by side, and the words' own hashes confirm them.
_WINDOWS = "CASE WHEN n_words >= 3 THEN transform(sequence(0, n_words - 3), i -> (xxhash64(h[i], h[i + 1], h[i + 2]) & keep) | i) ELSE array() END"
_PAIRS = """filter(zip_with(sorted, slice(sorted, 2, greatest(size(sorted) - 1, 0)), (a, b) ->
    IF(b IS NOT NULL AND (a & keep) = (b & keep), IF(
        h[CAST(a & ~keep AS INT)] = h[CAST(b & ~keep AS INT)] AND h[CAST(a & ~keep AS INT) + 1] = h[CAST(b & ~keep AS INT) + 1] AND h[CAST(a & ~keep AS INT) + 2] = h[CAST(b & ~keep AS INT) + 2],
        shiftleft(a & ~keep, 31) | (b & ~keep), -1L), -1L)), p -> p >= 0)"""
_STARTS = "array_distinct(concat(transform(pairs, p -> CAST(shiftright(p, 31) AS INT)), transform(pairs, p -> CAST(p & 2147483647L AS INT))))"
_COVERED = "CASE WHEN size(pairs) = 0 THEN 0L ELSE CAST(size(array_distinct(concat(starts, transform(starts, p -> p + 1), transform(starts, p -> p + 2)))) AS BIGINT) END"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: dict[str, str] | None = None) -> DataFrame:
    """doc_id and the statistics of each whole text, as bigint: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_capitals, n_marks.

    A null text counts as empty, and all statistics of an empty text are 0. Other columns of docs are left out, so
    their names don't matter, but for those of `carried` (column -> its name in the result), which go along, so that a
    decision needs no join to reach its row. Repeated rows give repeated rows."""
    with_row = [F.col(c).alias(n) for c, n in (carried or {}).items()]
    own = list((carried or {}).values())
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *with_row)
        .select(
            "doc_id", *own,
            words(F.col("__text")).alias("w"),
            lines.alias("lines"),
            removed(SYMBOLS + "+").alias("n_symbols"),
            removed(r"[A-ZÀ-ÖØ-Þ]+").alias("n_capitals"),
            removed("[!?]+").alias("n_marks"),
        )
        .select(
            "doc_id", *own, "n_symbols", "n_capitals", "n_marks",
            F.size("w").cast("bigint").alias("n_words"),
            F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        )
        .withColumn("keep", F.expr("coalesce(shiftleft(-1L, length(bin(n_words))), -1L)"))
        .withColumn("sorted", F.sort_array(F.expr(_WINDOWS)))
        .withColumn("pairs", F.expr(_PAIRS))
        .withColumn("starts", F.expr(_STARTS))
        .withColumn("n_repeat_words", F.expr(_COVERED))
        .select("doc_id", *own, F.explode(F.array(F.struct(*STATISTICS))).alias("s"))
        .select("doc_id", *own, "s.*")  # conditions on statistics stay behind the generator: nothing is computed twice
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.threshold) == self.above

    def sql(self) -> str:
        return f"({FEATURES.get(self.feature, self.feature)}) {'>=' if self.above else '<'} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _best(rows: list[tuple[dict, int]], features: list[str]) -> tuple[float, Condition] | None:
    """The condition of most FOIL gain. Thresholds lie halfway between neighbouring values."""
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return None
    base, found = log2(p0 / (p0 + n0)), None
    for f in features:
        p = n = 0
        ordered = sorted((r[f], y) for r, y in rows)
        for k in range(len(ordered) - 1):
            p, n = p + ordered[k][1], n + 1 - ordered[k][1]
            if ordered[k][0] == ordered[k + 1][0]:
                continue
            cut = (ordered[k][0] + ordered[k + 1][0] + 1) // 2
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if a and (gain := a * (log2(a / (a + b)) - base)) > (found[0] if found else 1e-9):
                    found = gain, Condition(f, above, cut)
    return found


def learn(rows: list[tuple[dict, int]], features: list[str], max_rules: int = 12, max_conditions: int = 4, precision: float = 0.85, support: int = 3) -> list[Rule]:
    """An ordered list of rules for the rows of label 1. rows: (feature values, label).

    Every third row only prunes. A pruned rule joins the list if it has `precision` on what it newly covers (of all
    rows, with Laplace's correction) and covers `support` rows; the first that doesn't ends the learning. The rows'
    order decides ties and which rows prune. Without rows of both labels there are no rules."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < max_rules:
        grow, prune = [r for k, r in enumerate(left) if k % 3], left[::3]
        conditions: list[Condition] = []
        covered = grow
        while len(conditions) < max_conditions and (found := _best(covered, features)):
            conditions.append(found[1])
            covered = [r for r in covered if found[1].holds(r[0])]
        if not conditions:
            break

        def worth(k: int) -> tuple[float, int]:
            hit = [y for r, y in prune if Rule(tuple(conditions[:k])).covers(r)]
            return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -k)

        rule = Rule(tuple(conditions[: max(range(1, len(conditions) + 1), key=worth)]))
        hit = [y for r, y in left if rule.covers(r)]
        if len(hit) < support or (sum(hit) + 1) / (len(hit) + 2) < precision:
            break
        rules.append(rule)
        left = [r for r in left if not rule.covers(r[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **options) -> list[Rule]:
    """The decision list that predicts labels.quality = 0 among rows that pass the base rules.

    About max_rows labels, half of each value, those of least hash of the id, are drawn before they meet any text: each
    pair of id and label counts once. This bounded sample is broadcast, only its documents' statistics are computed,
    and of these the numbers of rows that pass the base rules come to the driver. Labels other than 0 and 1, null ids
    and labels without a document don't count."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = F.broadcast(bounded_sample(marked, "quality", "doc_id", max_rows // 2))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    stats = statistics(rows, carried={"quality": "quality"}).where(~base_failed())
    found = stats.select(F.xxhash64("doc_id").alias("h"), "quality", *(F.expr(e).cast("long").alias(f) for f, e in FEATURES.items())).collect()
    return learn([({f: r[f] for f in FEATURES}, int(r["quality"] == 0)) for r in sorted(found)], list(FEATURES), **options)


def verdict(rules: list[Rule]) -> Column:
    """True where a document is kept: the first rule that covers it rejects it."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(F.expr(rule.sql()), F.lit(False))
    return out.otherwise(F.lit(True))
