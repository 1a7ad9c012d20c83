"""Fill-in-the-middle: documents cut in three at random units and put together in another order.

A unit is a word with the white space before it, or white space at the end of a
text, so cuts never fall inside a word. Where a document is cut and what form
it takes follow from a digest of the seed and its identifier alone.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points; four bytes a unit."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def draws(seed: int | str, doc_id: str) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the identifier."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def arrange(text: str, ends: array, numbers: list[int], percent: int, percent_spm: int) -> tuple[str, str, int | None, int | None]:
    """(form, output, code points of the prefix, of the middle)."""
    if not text or numbers[2] % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, text, None, None
    n = len(ends)
    first, last = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    if numbers[3] % 100 < percent_spm:
        return SPM, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}", a, b - a
    return PSM, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}", a, b - a


def rebuild(output: str, form: str) -> str:
    """The text that ``arrange`` took apart, from what it made."""
    if form == PLAIN:
        return output
    one, other = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    front, _, middle = output.partition(MIDDLE)
    head, _, tail = front.removeprefix(one).partition(other)
    return f"{head}{middle}{tail}" if form == PSM else f"{tail}{middle}{head}"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int | str = 42, percent: int = 50, percent_spm: int = 80, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rearranges ``percent`` of a hundred documents, ``percent_spm`` of these suffix first.

    Returns a row for each document: the id column, n (units), form (plain,
    psm, spm), prefix_chars, middle_chars (null where plain), output (the text
    to train on; left out unless ``texts``), output_sha256 and restored_sha256,
    the digest of the text as rebuilt from output and form.

    One projection without an exchange; a document's offsets take four bytes a
    unit. A null text is empty and plain, as is a text that holds a mark. A
    null identifier counts as an empty one; equal identifiers draw the same
    numbers, and repeated rows stay. Whole texts are taken, however long.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    if id_col in ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"):
        raise ValueError(f"the result has a column {id_col} of its own")
    kind = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + (", output string" if texts else "")

    @F.pandas_udf(kind)
    def cut(ids: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(ids, bodies, strict=True):
            ends = unit_ends(text)
            form, output, before, middle = arrange(text, ends, draws(seed, doc_id), percent, percent_spm)
            row = (len(ends), form, before, middle, _digest(output), _digest(rebuild(output, form)))
            rows.append((*row, output) if texts else row)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = docs.select(F.col(id_col).alias("id"), cut(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).alias("made"))
    order = ["n", "form", "prefix_chars", "middle_chars", *(["output"] if texts else []), "output_sha256", "restored_sha256"]
    return made.select(F.col("id").alias(id_col), *[F.col(f"made.{c}").alias(c) for c in order])
