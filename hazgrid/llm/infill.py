"""Fill-in-middle transformation: a text is cut in three, and the middle goes to the end.

One Aho-Corasick automaton finds the ASCII characters that change the class of a text (white space and signs; all else counts
as letters) and the sentinels. Between two such events a text is of one class, so the number of units there follows from
its length, and the place of a unit is found by a binary search over events. Units are code points, or runs: of letters,
of white space, and single signs.

Scale: one pass in Arrow batches of bounded size, no shuffle; the text is put together again by column functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.common import SPACES
from hazgrid.llm.tokens import slices

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
SPACE, SIGN, SENTINEL = 0, 1, 2
#: Of a hundred texts, those from here on stay plain; of a hundred others, those below come with the suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for words, kind in ((SPACES, SPACE), (SIGNS, SIGN), (SENTINELS, SENTINEL)):
        for word in words:
            found.add_word(word, kind)
    found.make_automaton()
    return found


class Units:
    """The units of ``text``: how many there are, where each begins, and whether a sentinel occurs."""

    def __init__(self, text: str, scan, unit: str):
        events = np.array(list(scan.iter(text)), np.int64).reshape(-1, 2)
        self.sentinel = bool((events[:, 1] == SENTINEL).any())
        events = events[events[:, 1] != SENTINEL]
        # A stretch begins at the text, at each event and after it.
        starts = np.unique(np.concatenate([np.zeros(1, np.int64), events[:, 0], events[:, 0] + 1]))
        self.starts, self.end = starts[starts < len(text)], len(text)
        lengths = np.diff(np.append(self.starts, self.end))
        self.arithmetic = unit == "code_point"
        if self.arithmetic:
            counts = lengths
        else:
            space = np.isin(self.starts, events[events[:, 1] == SPACE, 0])
            counts = np.where(space & np.append(False, space[:-1]), 0, 1)  # white space goes on
        self.first = np.cumsum(counts) - counts
        self.n = int(counts.sum())

    def place(self, rank: int) -> int:
        """Where unit ``rank`` begins; the end of the text for the number of units."""
        if rank >= self.n:
            return self.end
        k = int(np.searchsorted(self.first, rank, side="right")) - 1
        return int(self.starts[k]) + (rank - int(self.first[k]) if self.arithmetic else 0)


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of a document, the same on every machine; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def transformed(text: str, doc_id: int | None, scan, unit: str = "code_point", seed: str = "1") -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output); see ``fill_in_middle``."""
    units = Units(text, scan, unit)
    a, b, c, d = draws(seed, doc_id)
    if not text or units.sentinel or c % 100 >= PLAIN_FROM:
        return units.n, "plain", None, None, text
    low, high = sorted((a % (units.n + 1), b % (units.n + 1)))
    low, high = units.place(low), units.place(high)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if d % 100 < SUFFIX_FIRST_BELOW:
        return units.n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", unit: str = "code_point", seed: str = "1") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null in plain ones) and output.

    Where a text is cut and which form it takes follows from its doc_id. Texts that hold a sentinel stay plain, and so do null
    and empty ones (output empty). Rows with equal doc_id and text come out alike, each as a row; a null doc_id stays null and
    draws the same for all such rows. Further columns are ignored, and an empty table gives no rows.
    """
    if unit not in ("code_point", "run"):
        raise ValueError(f"no unit {unit}")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton()
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = part.column(0).to_pylist()
                rows = [transformed(t, i, scan, unit, seed) for t, i in zip(part.column(1).to_pylist(), ids, strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                longs = [pa.array(x, pa.int64()) for x in (ids, n, prefix, middle)]
                yield pa.RecordBatch.from_arrays([*longs[:2], pa.array(form, pa.string()), *longs[2:], pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return source.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``output`` was made of. A sentinel can't begin within one or at a border, so each is found where it was put."""
    whole = F.col(output)
    head, middle = F.substring_index(whole, MIDDLE, 1), F.substring_index(whole, MIDDLE, -1)

    def parts(mark: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, mark, 1), F.lit(4)), F.substring_index(head, mark, -1)

    (prefix, suffix), (later, earlier) = parts(SUFFIX), parts(PREFIX)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(earlier, middle, later)).otherwise(whole)


def op12_fill_in_middle(spark, sf_dir):
    """Digests of all documents' outputs, and of the texts that are put together from them."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS x FROM documents),
g AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(x, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS d FROM h),
f AS (SELECT doc_id, n, t, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, substr(t, 1, p) AS x, substr(t, p + 1, m) AS y, substr(t, p + m + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM s
"""
