"""Evaluation texts leaking into documents.

Method: latent semantic retrieval.  Texts are cut into passages of 24 words,
one every 12; terms are the words of the evaluation items.  One pass over the
corpus counts document frequencies and sketches the TF-IDF matrix of all
passages (randomised range finder, summed over partitions).  The sketch gives
the dominant directions of the corpus; the item passages' own singular vectors
extend them to an orthonormal latent basis that keeps nearly all of the items'
energy.  Corpus and item passages are compared in the latent space, and a
longest common run or subsequence is checked on candidates.

The corpus is read once, with the vocabulary of all items, whatever their
number.  What is kept of it, passages that may matter, is then searched for the
items in parts of bounded bytes (PART_BYTES); nothing decided depends on how
the items are cut into parts.

Candidate search loses no leak.  With q and d the TF-IDF vectors of an item
passage and a corpus passage, q·d is at most the latent product plus the
product of the residual norms.  A corpus passage that holds 12 consecutive
words of an item passage has q·d of at least the least sum of squared weights
of any 12 consecutive words of it; only pairs whose bound stays below that are
dropped, and the longest common run decides on the pairs that stay.  Any run of 12 words lies whole in one passage of 24 taken every 12,
on both sides.  Passages without 12 words of the items in a row
hold no run and are skipped.  Document frequencies are over blocks of 12 words.

Paraphrases have a filter of their own, also lossless: to keep a share of an
item passage's words in order, a passage must hold at least as many words of it,
wherever they stand and whatever stands between them.  Their cosine is bounded
in the same way, so the latent space only saves work; the exact cosine decides.

Texts are normalised first: escapes, entities, tags, invisible characters,
line prefixes (quotes, comments, line numbers) and string joints vanish, case
and punctuation too; a word broken at a line end is joined if that gives a
word of an item, and kept as two otherwise.

Defined results: a null or empty text or item matches nothing; items of fewer
than 12 words cannot leak; each (document, item) appears once; copies of a
document each appear; a run never crosses the bounds of a cell.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.cells import cell_lists, steps
from tidewell.session import small_batches, staged

RUN = 12
PASSAGE = 2 * RUN
#: Latent dimensions taken from the corpus and sketch columns.
RANK = 32
SKETCH = 40
#: Share of the item passages' energy that the latent space keeps, and its greatest dimension.
ENERGY = 0.995
MOST_DIMENSIONS = 1024
SEED = 20240229
#: Bytes of the largest table of a part of the items: passages times distinct words.
PART_BYTES = 64_000_000

_word = re.compile(r"[^\W_]+|[\x01\x02\x03]")
_invisible = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]+")
_escape = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8})|([nrtfv])|(.))", re.S)
_inline = re.compile(r"</?(?:a|abbr|b|bdi|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]{0,300})?/?>", re.I)
_block = re.compile(r"</?[A-Za-z!][^<>]{0,300}>|<!--.*?-->", re.S)
_number = re.compile(r"^[ \t]*\d+[ \t]*[|:│][ \t]?", re.M)
# a hyphen at a line end, also of a string literal that goes on in the next line
_hyphen_end = re.compile(r"[-‐‑¬][\"']?[ \t]*[\\+]?[ \t]*\r?\n")
CELL, BREAK, LINE = "\x01", "\x02", "\x03"
_ascii = {c: (chr(c) if chr(c).isalnum() or c in (1, 2, 3) else " ") for c in range(128)}


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        n = int(code, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    return "\n" if m[4] else m[5]


def normalise(text: str) -> list[str]:
    """The words of a text, with marks at the bounds of cells and lines."""
    if "\\" in text:
        text = _escape.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _block.sub(" ", _inline.sub("", text))
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", _invisible.sub("", text))
        plain = text.isascii()
    text = text.lower()
    if "|" in text or "│" in text:
        text = _number.sub("", text)
    if "\n" in text:
        text = _hyphen_end.sub(f" {BREAK} ", text).replace("\n", f" {LINE} ")
    return text.translate(_ascii).split() if plain else _word.findall(text)


def numbered(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Words as numbers, 0 for others; broken words joined, marks of lines gone.

    Words on both sides of a hyphen at a line end are one if that is a word of
    an item.  Without a hyphen they are one only if they aren't both words of
    items themselves."""
    get = vocabulary.get
    ids = np.array([get(w, 0) for w in words], np.int32)
    marks = np.flatnonzero(ids < 0)
    if len(marks):
        last = len(words) - 1
        kind = ids[marks]
        inner = (marks > 0) & (marks < last) & ((kind == _MARKS[BREAK]) | (kind == _MARKS[LINE]))
        at = marks[inner]
        left, right = ids[at - 1], ids[at + 1]
        look = at[(left >= 0) & (right >= 0) & ((ids[at] == _MARKS[BREAK]) | (left == 0) | (right == 0))]
        for i in look.tolist():
            whole = get(words[i - 1] + words[i + 1], 0)
            if whole > 0 and ids[i - 1] >= 0:
                ids[i - 1] = _GONE
                ids[i + 1] = whole
        ids = ids[(ids >= 0) | (ids == _MARKS[CELL])]
        ids[ids < 0] = 0
    return ids


_MARKS = {CELL: -1, BREAK: -2, LINE: -3}
_GONE = -4


class Items:
    """The evaluation items: their vocabulary and passages, as numbers.

    About four bytes a word of the items, and the vocabulary, are held by driver and tasks."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = [(i, [w for w in normalise(t) if w not in _MARKS]) for i, t in rows if t]
        self.words = sorted({w for _, ws in words for w in ws})
        self.vocabulary = {w: n + 1 for n, w in enumerate(self.words)} | _MARKS
        #: The type that holds every number; what is staged is as small as it can be.
        self.kind = np.uint16 if len(self.words) < 65_535 else np.uint32
        passages, whole, wide, owner = [], [], [], []
        for item, ws in words:
            ids = np.array([self.vocabulary[w] for w in ws], self.kind)
            if len(ids) < RUN:
                continue
            for i in range(0, max(1, len(ids) - RUN + 1), RUN):
                passages.append(np.pad(ids[i : i + PASSAGE], (0, max(0, PASSAGE - len(ids[i : i + PASSAGE])))))
                # behind a short last passage stand the item's last 24 words
                last = ids[max(0, min(i, len(ids) - PASSAGE)) :][:PASSAGE]
                whole.append(np.pad(last, (0, PASSAGE - len(last))))
                wide.append(np.pad(ids[i : i + PASSAGE + RUN], (0, max(0, PASSAGE + RUN - len(ids[i : i + PASSAGE + RUN])))))
                owner.append(item)
        self.passages = np.array(passages, self.kind).reshape(-1, PASSAGE)
        #: With the 12 words that follow: these hold all 24 words in a row that begin in the first 12.
        self.wide = np.array(wide, self.kind).reshape(-1, PASSAGE + RUN)
        self.whole = np.array(whole, self.kind).reshape(-1, PASSAGE)
        self.owner = np.array(owner, np.int64)

    @property
    def size(self) -> int:
        return len(self.words) + 1

    def parts(self, most: int) -> list[slice]:
        """Runs of passages whose tables of passages x distinct words (float) have at most so many bytes."""
        out, start = [], 0
        step = 64
        seen: set[int] = set()
        for at in range(0, len(self.owner), step):
            more = set(np.unique(self.wide[at : at + step]).tolist())
            end = min(at + step, len(self.owner))
            if at > start and 4 * (end - start) * len(seen | more) > most:
                out.append(slice(start, at))
                start, seen = at, set()
            seen |= more
        if len(self.owner) > start:
            out.append(slice(start, len(self.owner)))
        return out


def test_matrix(size: int) -> np.ndarray:
    """The sketch's random columns, the same in every task."""
    g = np.random.default_rng(SEED).standard_normal((size, SKETCH)).astype(np.float32)
    g[0] = 0  # number 0: not a word of the items
    return g


def passages_of(ids: np.ndarray) -> np.ndarray:
    """Overlapping passages (n, 24) of a word sequence; the tail is padded."""
    blocks = max(1, -(-len(ids) // RUN))
    padded = np.zeros((blocks + 1) * RUN, ids.dtype)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[::RUN]


_SCHEMA = "kind string, doc_id bigint, words binary, term int, n bigint, y array<float>"


def holds_run(blocks: np.ndarray) -> np.ndarray:
    """Passages (by first block) that may hold a run of 12: 12 words of the items in a row."""
    known = (blocks > 0).sum(1)
    rich = np.flatnonzero(known[:-1] + known[1:] >= RUN)
    if len(rich):
        both = np.concatenate([blocks[rich], blocks[rich + 1]], axis=1) > 0
        row_sum = np.cumsum(np.pad(both, ((0, 0), (1, 0))), axis=1)
        rich = rich[(row_sum[:, RUN:] - row_sum[:, :-RUN] == RUN).any(axis=1)]
    return rich


class Overlap:
    """Which passages hold enough words of an item passage to keep least_share of it."""

    def __init__(self, wide: np.ndarray, size: int, least_share: float):
        length = np.minimum((wide > 0).sum(1), PASSAGE)
        # passages of fewer than 12 words are never asked for
        self.need = np.where(length >= RUN, np.minimum(np.ceil(least_share * length), 255), 255).astype(np.uint8)
        self.least = int(self.need.min(initial=255))
        #: Numbers of this part's own words, 0 for others.
        self.local = np.zeros(size, np.int32)
        own = np.unique(wide)
        own = own[own > 0]
        self.local[own] = np.arange(1, len(own) + 1)
        self.holds = np.zeros((len(own) + 1, len(wide)), np.uint8)
        self.holds[self.local[wide].ravel(), np.repeat(np.arange(len(wide)), wide.shape[1])] = 1
        self.holds[0] = 0

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Rows of words x item passages: how many of the words are in the item passage."""
        n = np.zeros((len(words), self.holds.shape[1]), np.uint8)
        for k in range(words.shape[1]):
            n += self.holds[self.local[words[:, k]]]
        return n

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.counts(words) >= self.need)

    def any(self, words: np.ndarray) -> np.ndarray:
        return (self.counts(words) >= self.need).any(axis=1)


class HoldsEnough:
    """Places (by first block) that hold enough words of any item passage in three blocks.

    24 words in a row, wherever they begin, lie in the three blocks from their
    first on.  Without overlaps only the number of known words is looked at;
    the search finds the same in what is kept."""

    def __init__(self, least: int, overlaps: list[Overlap]):
        self.least, self.overlaps = least, overlaps

    def __call__(self, blocks: np.ndarray) -> np.ndarray:
        known = np.pad((blocks > 0).sum(1), (0, 1))
        rich = np.flatnonzero(known[:-2] + known[1:-1] + known[2:] >= self.least)
        if not self.overlaps:
            return rich
        out = []
        for at in range(0, len(rich), 2048):
            i = rich[at : at + 2048]
            words = np.concatenate([blocks[i], blocks[i + 1], blocks[np.minimum(i + 2, len(blocks) - 1)]], axis=1)
            good = np.zeros(len(i), bool)
            for o in self.overlaps:
                todo = np.flatnonzero(~good)
                good[todo] = o.any(words[todo])
            out.append(i[good])
        return np.concatenate(out) if out else rich


def _read(items: Items, wanted=holds_run, around: int = 0):
    """wanted: from all blocks of a step to the first blocks of the passages that
    are searched; they come with so many blocks of the document before and after."""
    vocabulary, size, small = items.vocabulary, items.size, items.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = test_matrix(size)
        sketch = np.zeros((size, SKETCH), np.float64)
        df = np.zeros(size, np.int64)
        passages = 0
        for batch in steps(batches):
            docs, hits = [], []
            sequences: list[np.ndarray] = []
            owners: list[int] = []
            for doc, cells in zip(batch.column("doc_id").to_pylist(), cell_lists(batch), strict=True):
                if doc is None or not cells:
                    continue
                # cells are normalised one by one where a tag or literal could reach into the next
                ids = numbered([w for _, t in cells for w in (CELL, *normalise(t))], vocabulary)
                sequences.append(np.concatenate([ids, np.zeros(PASSAGE + (-len(ids)) % RUN, ids.dtype)]))
                owners.append(doc)
            if not sequences:
                continue
            # documents are set one after another, kept apart by a passage of non-words
            stream = np.concatenate(sequences)
            block_doc = np.repeat(np.arange(len(sequences)), [len(s) // RUN for s in sequences])
            blocks = stream.reshape(-1, RUN)
            known = (blocks > 0).sum(1)
            busy = np.flatnonzero(known)
            passages += len(blocks)
            # counts: a passage is a block and the next; tf is kept per block and added
            position = np.full(len(blocks) + 1, -1, np.int64)
            position[busy] = np.arange(len(busy))
            own = random[blocks[busy]].sum(1)
            after = position[busy + 1]
            z = own + np.where((after >= 0)[:, None], own[after], 0)  # latent image of the passages that begin here
            # each word lies in two passages; one that begins with an empty block is this block alone
            before = position[busy - 1]
            earlier = np.where((before >= 0)[:, None], z[before], own)
            zz = z + np.where((busy > 0)[:, None], earlier, 0)
            flat = blocks[busy]
            row, col = np.nonzero(flat)
            terms = flat[row, col]
            order = np.argsort(terms, kind="stable")
            t, r = terms[order], row[order]
            if len(t):
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                sketch[t[first]] += np.add.reduceat(zz[r], first, axis=0)
                by_block = np.sort(flat, axis=1)
                df += np.bincount(by_block[:, 0], minlength=size) + np.bincount(by_block[:, 1:][by_block[:, 1:] != by_block[:, :-1]], minlength=size)
            rich = wanted(blocks)
            # not from the non-words between two documents into the next
            rich = rich[block_doc[rich] == block_doc[rich + 1]]
            places = rich[:, None] + np.arange(-around, 2 + around)
            inside = np.clip(places, 0, len(blocks) - 1)
            words = np.where(((places == inside) & (block_doc[inside] == block_doc[rich][:, None]))[:, :, None], blocks[inside], 0).astype(small)
            for i, w in zip(rich.tolist(), words, strict=True):
                docs.append(owners[block_doc[i]])
                hits.append(w.tobytes())
            if docs:
                n = len(docs)
                yield _batch(["passage"] * n, docs, hits, [None] * n, [None] * n, [None] * n)
        df[0] = 0
        some = np.flatnonzero(df).tolist()
        yield _batch(["term"] * len(some) + ["all"], [None] * (len(some) + 1), [None] * (len(some) + 1), [*some, 0], [*df[some].tolist(), passages], [*sketch[some].astype(np.float32), None])

    return run


def _batch(kind, doc, words, term, n, y) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), pa.array(doc, pa.int64()), pa.array(words, pa.binary()), pa.array(term, pa.int32()), pa.array(n, pa.int64()), pa.array(y, pa.list_(pa.float32()))],
        ["kind", "doc_id", "words", "term", "n", "y"],
    )


def latent_basis(read: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(idf weights, orthonormal basis size x RANK) from the summed partial sketches.

    What reaches the driver is bounded by the vocabulary of the items."""
    freq = read.filter("kind = 'term'").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = read.filter("kind = 'all'").agg(F.sum("n")).first()[0] or 1
    y = np.zeros((size, SKETCH))
    sums = read.filter("kind = 'term'").select("term", F.posexplode("y").alias("k", "v")).groupBy("term", "k").agg(F.sum(F.col("v").cast("double")).alias("v"))
    for r in sums.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).collect():
        y[r["term"]] = [x["v"] for x in r["v"]]
    weight = np.full(size, np.log(1 + total))
    for r in freq:
        weight[r["term"]] = np.log(1 + total / r["n"])
    weight[0] = 0
    # The random columns were drawn for tf, not TF-IDF: y holds T'TG, and with
    # weights D the TF-IDF matrix A = TD has A'A (D^-1 G) = D y.
    sketch = weight[:, None] * y
    if not y.any():
        return weight, np.zeros((size, RANK))
    # the leading left singular vectors of the sketch span the dominant latent directions
    u, _, _ = np.linalg.svd(sketch, full_matrices=False)
    return weight, u[:, :RANK]


class Search:
    """A part of the item passages in the latent space, with what is needed for the bound.

    Only the part's own words have columns: others add nothing to a product with its passages."""

    def __init__(self, items: Items, part: slice, weight: np.ndarray, basis: np.ndarray):
        self.passages, self.wide, self.whole, self.owner, self.kind = items.passages[part], items.wide[part], items.whole[part], items.owner[part], items.kind
        self.weight = weight.astype(np.float32)
        own = np.unique(self.wide)
        own = own[own > 0]
        self.local = np.zeros(items.size, np.int32)
        self.local[own] = np.arange(1, len(own) + 1)
        self.columns = len(own) + 1
        self.own_weight = np.concatenate([[0], weight[own]]).astype(np.float32)
        x = self.vectors(self.passages)
        corpus = np.concatenate([np.zeros((1, basis.shape[1])), basis[own]]).astype(np.float32)
        corpus = np.linalg.qr(corpus)[0] if corpus.any() else corpus
        # what the corpus directions leave of the item passages, by its singular vectors
        left = x - (x @ corpus) @ corpus.T
        _, strength, v = np.linalg.svd(left, full_matrices=False)
        energy = np.cumsum(strength**2) / max(float((strength**2).sum()), 1e-12)
        keep = min(int(np.searchsorted(energy, ENERGY)) + 1, MOST_DIMENSIONS, int((strength > 1e-4 * max(strength.max(initial=0), 1e-12)).sum()))
        self.basis = np.linalg.qr(np.concatenate([corpus, v[:keep].T], axis=1))[0].astype(np.float32)
        self.latent = x @ self.basis
        self.residual = np.sqrt(np.maximum((x * x).sum(1) - (self.latent * self.latent).sum(1), 0))
        squares = self.weight[self.passages] ** 2
        sums = np.lib.stride_tricks.sliding_window_view(squares, RUN, axis=1).sum(2)
        whole = np.lib.stride_tricks.sliding_window_view(self.passages > 0, RUN, axis=1).all(2)
        self.least = np.where(whole, sums, np.inf).min(1) if len(self.passages) else np.zeros(0)

    def vectors(self, words: np.ndarray) -> np.ndarray:
        places = np.arange(len(words))[:, None] * self.columns + self.local[words]
        x = np.bincount(places.ravel(), minlength=len(words) * self.columns).reshape(len(words), self.columns)
        return x.astype(np.float32) * self.own_weight

    @property
    def chunk(self) -> int:
        """Passages per step: vectors of about 16 MB."""
        return max(64, 4_000_000 // max(self.columns, len(self.owner)))

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corpus passage, item passage) of pairs that may share a run."""
        x = self.vectors(words)
        d = x @ self.basis
        rest = np.sqrt(np.maximum((x * x).sum(1) - (d * d).sum(1), 0))
        bound = d @ self.latent.T + rest[:, None] * self.residual[None, :]
        return np.nonzero(bound >= self.least[None, :] * (1 - 1e-4) - 1e-3)

    def may_be_close(self, have: np.ndarray, want: np.ndarray, least_cosine: float) -> np.ndarray:
        """Pairs (row by row) whose cosine can reach least_cosine by what the latent space shows of it."""
        x, z = self.vectors(have), self.vectors(want)
        d, q = x @ self.basis, z @ self.basis
        rest = np.sqrt(np.maximum((x * x).sum(1) - (d * d).sum(1), 0) * np.maximum((z * z).sum(1) - (q * q).sum(1), 0))
        return (d * q).sum(1) + rest >= least_cosine * np.sqrt(squared(have, self.weight) * squared(want, self.weight)) * (1 - 1e-4)


def dot(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Products of the TF-IDF vectors of the words in the rows of a and of b."""
    out = np.zeros(len(a), np.float64)
    for k in range(a.shape[1]):
        out += weight[a[:, k]].astype(np.float64) ** 2 * (b == a[:, k, None]).sum(1)
    return out


def squared(a: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return dot(a, a, weight)


def common_run(a: np.ndarray, b: np.ndarray, least: int = RUN) -> np.ndarray:
    """Whether each row of a shares so many words in a row with the row of b; 0 is no word."""
    found = np.zeros(len(a), bool)
    width = a.shape[1]
    for shift in range(least - width, width - least + 1):
        at = np.flatnonzero(~found)
        left, right = a[at, max(0, shift) : width + min(0, shift)], b[at, max(0, -shift) : width - max(0, shift)]
        same = np.cumsum(np.pad((left == right) & (left > 0), ((0, 0), (1, 0))), axis=1)
        found[at] = (same[:, least:] - same[:, :-least] == least).any(1)
    return found


def _items(items: DataFrame, item: str = "item_id", text: str = "text") -> Items:
    rows = items.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    return Items([(r["i"], r["t"]) for r in rows.toLocalIterator()])


def _searched(documents: DataFrame, items: Items, wanted=holds_run, around: int = 0) -> tuple[DataFrame, Iterator[Search]]:
    """Passages that may matter, and the parts of the items in the latent space, one by one."""
    with small_batches(documents.sparkSession):
        read = staged(documents.select("doc_id", "text", "cells").mapInArrow(_read(items, wanted, around), _SCHEMA), "passages")
    weight, basis = latent_basis(read, items.size)
    return read.filter("kind = 'passage'").select("doc_id", "words"), (Search(items, p, weight, basis) for p in items.parts(PART_BYTES))


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold 12 consecutive words of an item."""
    items = _items(eval_items)
    if not len(items.passages):
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    passages, searches = _searched(documents, items)
    out = None
    for search in searches:
        found = _leaks(passages, search)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _leaks(passages: DataFrame, search: Search) -> DataFrame:
    shared = passages.sparkSession.sparkContext.broadcast(search)  # a part is at most a few PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            docs, out = batch.column(0).to_numpy(), set()
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), s.kind).reshape(-1, PASSAGE)
            for at in range(0, len(words), s.chunk):
                part = words[at : at + s.chunk]
                i, j = s.candidates(part)
                for k in range(0, len(i), PAIRS):
                    a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                    good = common_run(part[a], s.passages[b])
                    out.update(zip(docs[at + a[good]].tolist(), s.owner[b[good]].tolist(), strict=True))
            found = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])

    return passages.mapInArrow(run, "doc_id bigint, item_id bigint")


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of words; 0 is no word."""
    best = np.zeros(len(b) + 1, np.int64)
    for w in a:
        if w == 0:
            continue
        grown = np.where(b == w, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], grown))
    return int(best[-1])


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """common_subsequence of each row of a with the row of b, of at most 62 words: a bit per word of b."""
    bit = np.int64(1) << np.arange(b.shape[1], dtype=np.int64)
    full = np.int64((1 << b.shape[1]) - 1)
    open_ = np.full(len(a), full)
    for k in range(a.shape[1]):
        match = ((b == a[:, k, None]) & (a[:, k, None] > 0)) @ bit
        open_ = ((open_ + (open_ & match)) | (open_ & ~match)) & full
    return b.shape[1] - np.bitwise_count(open_).astype(np.int64)


def keeps_numbers(a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each row of a holds every number of the row of b."""
    ok = np.ones(len(a), bool)
    for k in range(b.shape[1]):
        asked = np.flatnonzero(ok & numbers[b[:, k]])
        ok[asked] = (a[asked] == b[asked, k, None]).any(1)
    return ok


#: Pairs of passages that are compared at once.
PAIRS = 20_000


def _aligned(s: Search, near: np.ndarray, a: np.ndarray, b: np.ndarray, numbers: np.ndarray, least_cosine: float, least_share: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, item passage, words, share) of the pairs that agree in some 24 words of
    near[a] that begin in its second 12, and some of wide[b] that begin in its first."""
    for y in range(RUN):
        # 24 words of the item that begin at y; the item's last passage may be shorter
        want = s.wide[b, y : y + PASSAGE]
        size = (want > 0).sum(1)
        fit = np.flatnonzero((size == PASSAGE) | ((y == 0) & (size >= RUN)))
        if not len(fit):
            continue
        p, q, want, size = a[fit], b[fit], want[fit], size[fit]
        held = common_subsequences(near[p, RUN:], want) >= least_share * size
        held &= keeps_numbers(near[p, RUN:], want, numbers)
        p, q, want, size = p[held], q[held], want[held], size[held]
        good = np.ones(len(p), bool)
        short = np.flatnonzero(size < PASSAGE)
        last = s.whole[q[short]]
        good[short] = (common_subsequences(near[p[short]], last) < least_share * PASSAGE) | keeps_numbers(near[p[short]], last, numbers)
        p, q, want, size = p[good], q[good], want[good], size[good]
        if not len(p):
            continue
        # what 24 words begin at x, of all places and x at once
        row = np.repeat(np.arange(len(p)), RUN)
        have = np.lib.stride_tricks.sliding_window_view(near[p, RUN:], PASSAGE, axis=1)[:, :RUN].reshape(-1, PASSAGE)
        kept = common_subsequences(have, want[row])
        good = (kept >= least_share * size[row]) & keeps_numbers(have, want[row], numbers)
        row, have, kept = row[good], have[good], kept[good]
        for k in range(0, len(row), 2000):
            r, h, n = row[k : k + 2000], have[k : k + 2000], kept[k : k + 2000]
            close = s.may_be_close(h, want[r], least_cosine)
            r, h, n = r[close], h[close], n[close]
            cosine = dot(h, want[r], s.weight) / np.maximum(np.sqrt(squared(h, s.weight) * squared(want[r], s.weight)), 1e-9)
            close = cosine >= least_cosine
            yield p[r[close]], q[r[close]], n[close], n[close] / size[r[close]]


def find_paraphrases(documents: DataFrame, eval_items: DataFrame, least_cosine: float = 0.5, least_share: float = 0.6) -> DataFrame:
    """(doc_id, item_id, words, share): 24 words of a document, wherever they begin,
    close in the latent space to 24 words in a row of an item, which keep
    least_share of these words in order and, the answer check, every number of
    them; words and share are those of the best such place.  Words between, of no item too, don't matter.  An item's last passage
    may be shorter, from 12 words on; where the item's last 24 words are kept
    too, so must be their numbers."""
    items = _items(eval_items)
    if not len(items.passages):
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, words bigint, share double")
    parts = items.parts(PART_BYTES)
    overlaps = [Overlap(items.wide[p], items.size, least_share) for p in parts]
    least = min(o.least for o in overlaps)
    # every task holds these tables while it reads; many parts are looked through later only
    light = sum(o.holds.nbytes for o in overlaps) <= PART_BYTES
    passages, searches = _searched(documents, items, HoldsEnough(least, overlaps if light else []), around=1)
    out = None
    for search, overlap in zip(searches, overlaps, strict=True):
        found = _paraphrases(passages, search, overlap, np.array([False, *[w.isdigit() for w in items.words]]), least_cosine, least_share)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("share", "words"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.words", "b.share")


def _paraphrases(passages: DataFrame, search: Search, overlap: Overlap, numbers: np.ndarray, least_cosine: float, least_share: float) -> DataFrame:
    shared = passages.sparkSession.sparkContext.broadcast((search, overlap, numbers))  # a part is at most a few PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, overlap, numbers = shared.value
        few = PAIRS // RUN
        for batch in batches:
            docs = batch.column(0).to_numpy()
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), s.kind).reshape(-1, 2 * PASSAGE)
            columns = [[np.zeros(0, kind)] for kind in (np.int64, np.int64, np.int64, np.float64)]
            for at in range(0, len(words), s.chunk):
                near = words[at : at + s.chunk]
                part = near[:, RUN:]
                i, j = overlap.pairs(part)
                for k in range(0, len(i), PAIRS):
                    a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                    good = common_subsequences(part[a], s.wide[b]) >= overlap.need[b]
                    a, b = a[good], b[good]
                    for m in range(0, len(a), few):
                        for found in _aligned(s, near, a[m : m + few], b[m : m + few], numbers, least_cosine, least_share):
                            for c, v in zip(columns, (docs[at + found[0]], s.owner[found[1]], *found[2:]), strict=True):
                                c.append(v)
            c = [np.concatenate(v) for v in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64())], ["doc_id", "item_id", "words", "share"])

    return passages.mapInArrow(run, "doc_id bigint, item_id bigint, words bigint, share double")
