"""Fill-in-middle examples: a text is cut at two places between tokens and its parts change places.

Tokens are runs of A-Z and a-z, and every other character by itself.  A token begins between two
adjacent characters unless both are letters, so beginnings are counted in chunks of bytes that overlap
by one, all chunks of a block of texts at once.  Prefix sums of the counts give each text's number of
tokens, from which its two cuts are drawn, and name the chunk that owns each cut; only those two
chunks are read again to find the place.

Places are found in numpy (a scalar Arrow function of the text), parts are put together by
expressions.  There is no shuffle; a task holds a batch of rows and the predicates of one block.  Cuts
and form follow from a digest of the document's id, so a lost task gives the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, without the one before it that it reads too, and of a block of chunks that are counted at once.
CHUNK, BLOCK = 4096, 1 << 22
SEED = 1
#: Of a hundred texts, how many stay as they are; of a hundred others, how many have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = MARKS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of an id; a null id is drawn for like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def beginnings(data: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token, and whether a character, begins at each byte of ``data[start:end]``; the byte in front is read too."""
    own = data[start:end]
    letter = _LETTER[data[start - 1 : end]] if start else np.concatenate([[False], _LETTER[own]])
    char = (own & 0xC0) != 0x80
    return char & ~(letter[1:] & letter[:-1]), char


def blocks_of(bounds: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``block`` bytes, or of one text, by the places where texts begin and the last ends."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + block, "right")) - 1)
        yield first, last
        first = last


def chunk_counts(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and characters that begin in each chunk; chunks begin at ``starts`` and end where the next does."""
    tokens, chars = np.zeros(len(starts), "i8"), np.zeros(len(starts), "i8")
    ends = np.append(starts[1:], bounds[-1])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        begin, char = beginnings(data, int(starts[at]), int(ends[to - 1]))
        inside = bounds[(bounds >= starts[at]) & (bounds < ends[to - 1])]
        begin[inside - starts[at]] = True  # a text's first token doesn't look at the text in front
        places = starts[at:to] - starts[at]
        tokens[at:to], chars[at:to] = np.add.reduceat(begin, places, dtype="i8"), np.add.reduceat(char, places, dtype="i8")
        at = to
    return tokens, chars


def cuts(data: np.ndarray, bounds: np.ndarray, one: np.ndarray, other: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> np.ndarray:
    """Rows ``n, a, b`` for each text ``data[bounds[i]:bounds[i + 1]]``: its tokens, and the characters in front of its cuts.

    The cuts lie in front of the tokens with the ranks ``one % (n + 1)`` and ``other % (n + 1)``, the less one first.
    """
    out = np.zeros((len(bounds) - 1, 3), "i8")
    for first, last in blocks_of(bounds, block):
        own = bounds[first : last + 1]
        sizes = np.diff(own)
        pieces = -(-sizes // chunk)
        if not pieces.sum():
            continue
        head = np.cumsum(pieces) - pieces  # of each text, its first chunk
        starts = np.repeat(own[:-1] - head * chunk, pieces) + np.arange(pieces.sum()) * chunk
        tokens, chars = chunk_counts(data, own, starts, block)
        before, chars_before = (np.concatenate([[0], np.cumsum(x)]) for x in (tokens, chars))
        n = before[head + pieces] - before[head]
        ranks = np.sort(np.stack([one[first:last] % (n + 1), other[first:last] % (n + 1)]), 0)
        places = np.zeros((2, last - first), "i8")
        owners = np.searchsorted(before, before[head] + ranks, "right") - 1
        for k in (0, 1):
            for i in np.flatnonzero(pieces).tolist():
                rank, owner = int(before[head[i]] + ranks[k, i]), int(owners[k, i])
                if ranks[k, i] == n[i]:
                    places[k, i] = chars_before[head[i] + pieces[i]] - chars_before[head[i]]
                    continue
                start, end = int(starts[owner]), int(min(starts[owner] + chunk, own[i + 1]))
                begin, char = beginnings(data, start, end)
                begin[0] |= start == own[i]
                at = np.flatnonzero(begin)[rank - before[owner]]
                places[k, i] = chars_before[owner] - chars_before[head[i]] + int(char[:at].sum())
        out[first:last] = np.stack([n, *places], 1)
    return out


def _places(chunk: int):
    @F.arrow_udf("n long, a long, b long")
    def places(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        whole = text.cast(pa.large_binary())
        _, offsets, data = whole.buffers()
        bounds = np.frombuffer(offsets, "i8")[whole.offset : whole.offset + len(whole) + 1]
        found = cuts(np.frombuffer(data, "u1") if data else np.empty(0, "u1"), bounds, one.to_numpy(), other.to_numpy(), chunk)
        return pa.StructArray.from_arrays([pa.array(x) for x in found.T], ["n", "a", "b"])

    return places


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: ``row`` (the row itself), ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``form`` is ``plain`` (the text as it is, without cuts), ``psm`` (prefix, suffix, middle) or ``spm``
    (the suffix first), each part behind its mark.  Texts that are empty or hold a mark are plain; a
    null text is an empty one.  Rows with one id and one text get one result, however often they
    repeat; a null id is an id like any other; an empty table gives an empty one.  Very long texts are
    read whole, each within one task.  Columns of ``docs``, whatever their names, are kept in ``row``.
    """
    of = lambda c: F.col("row").getField(c)
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("whole", F.coalesce(of(text_col), F.lit("")))
    h = draws(of(id_col), seed)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("whole", F.lit(mark))
    plain = (F.col("whole") == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    cut = rows.withColumns({"places": _places(size)("whole", h[0], h[1]), "form": form}).select("row", "whole", "form", "places.*")
    whole, changed = F.col("whole"), F.col("form") != "plain"
    prefix, middle, suffix = F.left(whole, F.col("a").cast("int")), F.substring(whole, (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), F.substring(whole, (F.col("b") + 1).cast("int"), F.length(whole))
    parts = [F.lit(PREFIX_MARK), prefix, F.lit(SUFFIX_MARK), suffix, F.lit(MIDDLE_MARK), middle]
    output = F.when(F.col("form") == "psm", F.concat(*parts)).when(F.col("form") == "spm", F.concat(*parts[2:4], *parts[:2], *parts[4:])).otherwise(whole)
    return cut.select("row", "n", "form", F.when(changed, F.col("a")).alias("prefix_chars"), F.when(changed, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: no part holds a mark, so the first of each kind is the template's."""
    from_ = lambda c, n: F.substring(c, F.lit(n + 1), F.length(c))
    body = from_(output, len(PREFIX_MARK))  # all marks are of one length
    parted = F.when(form == "psm", F.lit(SUFFIX_MARK)).otherwise(PREFIX_MARK)
    one = F.substring_index(body, SUFFIX_MARK, 1), F.substring_index(body, PREFIX_MARK, 1)
    first = F.when(form == "psm", one[0]).otherwise(one[1])
    rest = F.substring(body, F.length(first) + F.length(parted) + 1, F.length(body))
    second = F.substring_index(rest, MIDDLE_MARK, 1)
    middle = F.substring(rest, F.length(second) + len(MIDDLE_MARK) + 1, F.length(rest))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(examples: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of examples."""
    again = restored(F.col("output"), F.col("form"))
    return examples.select(F.col("row").getField(id_col).alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
