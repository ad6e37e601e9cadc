"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is cut into units by a pattern, matched left to right, that matches no empty text.
The first pass counts the matches; the second advances a lazy iterator of matches to two
drawn ranks and reads off where these units end.  No list of units exists at any time:
besides the text, a task holds one match.  The text is then laid out anew as prefix, suffix and middle (psm) or as
suffix, prefix and middle (spm) between marks; texts that are empty or that hold a mark,
and a drawn share of the others, stay plain.

Draws come from the SHA-256 of ``seed:doc_id``, so they are the same in every run and on
every cluster.  ``restored`` rebuilds the text from output and form: no text that is laid
out anew holds a mark, and no mark overlaps itself or another, so cutting the output at
marks gives back the three parts.

Query ``op11_fill_in_middle``: units are code points.  One row per row of ``documents``.
Null texts are empty texts, and plain.  A null doc_id draws from ``seed:`` alone.
Repeated rows and doc_ids are worked out each for itself, and alike where doc_id and text
are.  Equal ranks give an empty middle.  Very long texts are read and laid out whole, one
at a time.  An empty table gives no rows; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import inf

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_text, docs_of, frugal, read_table

#: One code point, line ends included.
CODE_POINT = r"(?s:.)"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
#: So many units are matched at once where they follow one another.
RUN = 64
#: Code points of output that go to the JVM at once; a longer one goes alone.
BATCH_CHARS = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Matches:
    """A lazy walk over the matches of a unit: what it holds is the place where the last
    one ended and how many there were.  Where so many are due, ``RUN`` units that follow
    one another are matched at once, each as it would be alone."""

    def __init__(self, unit: str, text: str) -> None:
        self.one, self.run = re.compile(unit), re.compile(f"(?>{unit}){{{RUN}}}")
        self.text, self.at, self.done, self.singly = text, 0, 0, 0

    def advance(self, due: float) -> bool:
        if due >= RUN and not self.singly:
            if run := self.run.match(self.text, self.at):
                self.at, self.done = run.end(), self.done + RUN
                return True
            self.singly = RUN
        found = self.one.search(self.text, self.at)
        if found is None:
            return False
        self.at, self.done, self.singly = found.end(), self.done + 1, max(0, self.singly - 1)
        return True

    def to(self, rank: float) -> int:
        """Where the unit with this rank (counted from 1; 0: none) ends."""
        while self.done < rank and self.advance(rank - self.done):
            pass
        return self.at


def count_units(unit: str, text: str) -> int:
    matches = Matches(unit, text)
    matches.to(inf)
    return matches.done


def ends_of(unit: str, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the units with these ranks end: one walk, to the larger rank and no further."""
    matches = Matches(unit, text)
    return matches.to(low), matches.to(high)


def draws(seed: int, doc_id: int | None) -> list[int]:
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(drawn[k : k + 8], 16) for k in range(0, 32, 8)]


def laid_out(unit: str, text: str, drawn: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    n = count_units(unit, text)
    if not text or drawn[2] % 100 >= PLAIN_FROM or re.search(MARKS, text):
        return n, "plain", None, None, text
    low, high = ends_of(unit, text, *sorted(d % (n + 1) for d in drawn[:2]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if drawn[3] % 100 < SPM_BELOW:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of
    ``docs`` (doc_id, text)."""

    @frugal
    def run(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(name, pa.string() if name in ("form", "output") else pa.int64()) for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")])
        ready, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py() or ""
                ready.append((doc_id, *laid_out(unit, text, draws(seed, doc_id))))
                held += len(text)
                if held >= BATCH_CHARS or len(ready) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
                    ready, held = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that was laid out: its three parts stand between the marks."""
    parts = F.split(output, MARKS, -1)
    prefix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def digested(docs: DataFrame) -> DataFrame:
    """What the query returns: the output and the text restored from it as digests."""
    found = fill_in_middle(docs)
    output = blank_text(F.col("output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, F.col("form")), 256).alias("restored_sha256"))


def fill_in_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(docs_of(read_table(spark, sf_dir, "documents"), "doc_id", "text"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS r2, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= {PLAIN_FROM} THEN 'plain' WHEN h4 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
