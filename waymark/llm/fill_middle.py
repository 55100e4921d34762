"""Fill-in-the-middle documents by a two-pass streaming matcher.

A text is cut into units, the matches of a pattern (lines by default), from left to right.
The first pass over a lazy match iterator only counts the units; two ranks drawn from a hash of
the document's id then say after how many units the prefix and the middle end.  The second pass
advances a fresh iterator to the greater rank at most and notes where it stands at each of the
two.  No array of units is ever made: besides the text and its pieces a document needs two
offsets.  Every row is decided by itself, so nothing is shuffled.

Defined results: a null text is taken as empty; an empty text, a text that holds one of the
sentinels, and a share of the others (``rate`` per cent aren't of it) are plain, which means that
their output is the text itself.  A null id hashes as if it had no digits.  Rows that repeat an
id are cut by the same hashes.  Characters that no unit covers belong to the piece that the next
unit falls into, or to the suffix; empty matches aren't units.  A very long text is held once, with its pieces.
The columns of the input pass through; one that is named like a result raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import append_columns, prepare

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
SEED = "7"
COLUMNS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]

#: The defaults of ``transform`` and the digests as DuckDB SQL.
ORACLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units
), pieces AS (
  SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""


def units(pattern: re.Pattern, text: str) -> Iterator[int]:
    """Where each unit of a text ends, one after another."""
    return (m.end() for m in pattern.finditer(text) if m.end() > m.start())


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """The four numbers of a document: two ranks, whether it stays plain, and its form."""
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(made[i : i + 8], 16) for i in (0, 8, 16, 24)]


def offsets(pattern: re.Pattern, text: str, first: int, last: int) -> tuple[int, int]:
    """Where the unit of rank ``first`` ends and where that of rank ``last`` does (first <= last)."""
    start = end = 0
    if last:
        for rank, at in enumerate(units(pattern, text), 1):
            if rank == first:
                start = at
            if rank == last:
                end = at
                break
    return start, end


def cut(text: str, doc_id: int | None, pattern: re.Pattern, rate: int, spm: int, sentinels: tuple[str, str, str], seed: str) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, code points of prefix and middle, output) of one text."""
    n = sum(1 for _ in units(pattern, text))
    h = draws(doc_id, seed)
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    start, end = offsets(pattern, text, *sorted(x % (n + 1) for x in h[:2]))
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", start, end - start, "".join((s, text[end:], p, text[:start], m, text[start:end]))
    return n, "psm", start, end - start, "".join((p, text[:start], s, text[end:], m, text[start:end]))


def transform(docs: DataFrame, pattern: str = LINES, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with (n, form, prefix_chars, middle_chars, output).

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix
    first.  ``restore`` turns an output back into its text.
    """
    prepare(docs.sparkSession)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def of(b: pa.RecordBatch) -> list[pa.Array]:
        compiled = re.compile(pattern)
        made = [cut(t.as_py() or "", i.as_py(), compiled, rate, spm, sentinels, seed) for i, t in zip(b.column(id_at), b.column(text_at))]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array((row[k] for row in made), type=kind) for k, kind in enumerate(kinds)]

    return append_columns(docs, COLUMNS, of)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output.  The pieces hold no sentinel, so the first of each ends a piece."""
    p, s, m = sentinels

    def three(first: str, second: str, third: str) -> list[Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(a) + F.lit(len(second) + 1))
        b = F.substring_index(rest, third, 1)
        return [a, b, F.substr(rest, F.length(b) + F.lit(len(third) + 1))]

    before, after, middle = three(p, s, m)
    psm = F.concat(before, middle, after)
    after, before, middle = three(s, p, m)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(before, middle, after)).otherwise(output)


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    back = restore(F.col("output"), F.col("form"))
    return done.select(F.col(id_col).cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
