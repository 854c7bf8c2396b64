"""Token counts that follow edits.

Texts are cut into pre-tokens by the tokenizer's pattern and pre-tokens into leaves of ``LEAF``, each with its own piece
of the text; a document keeps a segment tree over its leaves with (characters, pre-tokens, tokens) sums in heap order.
An edit (position, characters removed, text put in) finds its leaf by the tree's character sums, goes back one
pre-token (the pattern looks one character ahead), and re-encodes from there until the pattern's cuts fall on an old cut
behind the edit; from there on the old counts hold. What is new goes into the first leaf touched, the others are
emptied, and the sums on the paths above them are updated. So an edit costs its region and the height of the tree, not
the length of the text; only a leaf that has grown to ``GROWN`` pre-tokens makes the tree be laid out anew.

The pattern is memoryless: a match depends only on where it starts and on what follows. So the first new cut that
meets an old cut behind the edit proves the rest. Counting is by byte-pair merges within a pre-token, so a count of
a pre-token never depends on its neighbours. Documents without edits are counted without a tree.

A null or empty text has no pre-token and 0 tokens; a very long text or run without blanks is counted whole. Edits are
in characters of the text as it is, in order, each on the result of the one before; an edit beyond the end is put at the
end; null edits are none. Repeated rows give repeated rows, an empty table none. Columns of the input are kept but for
the text, a column of edits, and those named as the added ones, whatever their case.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import table, without

#: Path of the ranks; the pattern is that of the public byte-level BPE vocabularies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, GROWN = 32, 256
#: Pre-tokens whose counts a task remembers.
REMEMBER = 200_000
ADDED = ("n_tokens", "n_tokens_edited", "n_edits", "n_pretokens", "n_reencoded")


def counter(path: str = VOCABULARY):
    """pre-token -> number of tokens by the ranks in a file."""
    with open(path, "rb") as f:
        return counter_of(f.read())


@functools.lru_cache(2)
def counter_of(ranks: bytes):
    """pre-token -> number of tokens, remembered up to a bound."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            if len(known) >= REMEMBER:
                known.clear()
            n = known[piece] = len(encoding.encode_ordinary(piece))
        return n

    return count


_cut = regex.compile(PATTERN)


@dataclass
class Tree:
    """Leaves (text, lengths of the pre-tokens, their counts) and sums in heap order."""

    texts: list[str]
    lengths: list[list[int]]
    counts: list[list[int]]
    sums: list[tuple[int, int, int]]  # (characters, pre-tokens, tokens); the root is at 1, leaves begin at `base`
    base: int

    @property
    def text(self) -> str:
        return "".join(self.texts)

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    @property
    def pretokens(self) -> int:
        return self.sums[1][1]


def _add(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _assemble(text: str, lengths: list[int], counts: list[int]) -> Tree:
    cuts = range(0, len(lengths), LEAF)
    leaves = [lengths[i : i + LEAF] for i in cuts]
    held = [counts[i : i + LEAF] for i in cuts]
    ends = [0, *itertools.accumulate(map(sum, leaves))]
    base = 1
    while base < len(leaves):
        base *= 2
    sums = [(0, 0, 0)] * base + [(sum(x), len(x), sum(y)) for x, y in zip(leaves, held, strict=True)]
    sums += [(0, 0, 0)] * (2 * base - len(sums))
    for i in range(base - 1, 0, -1):
        sums[i] = _add(sums[2 * i], sums[2 * i + 1])
    return Tree([text[a:b] for a, b in itertools.pairwise(ends)], leaves, held, sums, base)


def build(text: str | None, count) -> Tree:
    pieces = _cut.findall(text or "")
    return _assemble(text or "", list(map(len, pieces)), list(map(count, pieces)))


def _find(tree: Tree, at: int) -> tuple[int, int]:
    """The leaf that holds a character position and where that leaf starts; the last leaf with any for the end."""
    i, start = 1, 0
    while i < tree.base:
        i *= 2
        if at >= start + tree.sums[i][0] and tree.sums[i + 1][1]:
            start += tree.sums[i][0]
            i += 1
    return i - tree.base, start


def _put(tree: Tree, leaf: int, text: str, lengths: list[int], counts: list[int]) -> None:
    """A leaf's new content, and the sums on its path."""
    tree.texts[leaf], tree.lengths[leaf], tree.counts[leaf] = text, lengths, counts
    i = tree.base + leaf
    tree.sums[i] = (len(text), len(lengths), sum(counts))
    while i > 1:
        i //= 2
        tree.sums[i] = _add(tree.sums[2 * i], tree.sums[2 * i + 1])


def edit(tree: Tree, at: int, remove: int, put: str, count) -> tuple[Tree, int]:
    """The tree after an edit (the same one, changed, but where it is laid out anew), and how many pre-tokens were
    encoded again."""
    whole = tree.sums[1][0]
    at = max(0, min(at, whole))
    end = min(at + max(remove, 0), whole)
    if not whole or not put and end - at == whole:
        new = build(put, count)
        return new, new.pretokens
    shift = len(put) - (end - at)
    # Left: the pre-token before the one that holds the character ahead of the edit.
    leaf, start = _find(tree, max(at - 1, 0))
    if start and start + tree.lengths[leaf][0] >= at:
        leaf, start = _find(tree, start - 1)
    own, begin, kept = tree.lengths[leaf], start, 0
    while kept + 2 < len(own) and begin + own[kept] + own[kept + 1] < at:
        begin += own[kept]
        kept += 1
    # Right: match until a cut falls on an old cut behind the edit. Leaves are read as the matches reach them.
    ahead, last, stop, old = [], leaf - 1, start, set()

    def read(until: int) -> None:
        nonlocal last, stop
        while stop <= until and stop < whole:
            last += 1
            if tree.lengths[last]:
                ahead.append(tree.texts[last])
                e = stop
                for n in tree.lengths[last]:
                    e += n
                    old.add(e)
                stop = e

    read(end)
    have = "".join(ahead)
    window = have[begin - start : at - start] + put + have[end - start :]
    ahead.clear()
    lengths, counts, pos = [], [], 0
    while True:
        here = begin + pos
        if here >= at + len(put) and (here - shift in old or here - shift == whole):
            done = here - shift
            break
        m = _cut.match(window, pos)
        # Two characters ahead decide a match.
        while stop < whole and (m is None or m.end() + 2 > len(window)):
            read(stop + len(window))
            window += "".join(ahead)
            ahead.clear()
            m = _cut.match(window, pos)
        lengths.append(m.end() - pos)
        counts.append(count(m[0]))
        pos = m.end()
    # The leaf in which that cut lies, and what of it still holds.
    final, e = _find(tree, max(done - 1, 0)) if done > start else (leaf, start)
    rest = 0
    while e < done:
        e += tree.lengths[final][rest]
        rest += 1
    text = tree.texts[leaf][: begin - start] + window[:pos] + "".join(tree.texts[final])[sum(tree.lengths[final][:rest]) :]
    new_l = own[:kept] + lengths + tree.lengths[final][rest:]
    new_c = tree.counts[leaf][:kept] + counts + tree.counts[final][rest:]
    for k in range(leaf + 1, final + 1):
        _put(tree, k, "", [], [])
    _put(tree, leaf, text, new_l, new_c)
    if len(new_l) > GROWN:
        tree = _assemble(tree.text, list(itertools.chain(*tree.lengths)), list(itertools.chain(*tree.counts)))
    return tree, len(lengths)


def count_edited(docs: DataFrame, edits: Column | str | Callable[[str], list[tuple[int, int, str]]] = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (text and others) with counts before and after edits: an array of (at, remove, put) structs, or a function of
    the text that gives such tuples. The vocabulary is read by the driver and broadcast (under a megabyte)."""
    docs = without(docs, *ADDED)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    taken = {"text"} | ({edits.lower()} if isinstance(edits, str) else set())
    keep = [c for c in docs.columns if c.lower() not in taken]
    made = callable(edits) and not isinstance(edits, Column)
    ready = docs if made else docs.withColumn("token_edits", F.col(edits) if isinstance(edits, str) else edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(ranks.value)
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("text")):
                text = text.as_py() or ""
                changes = edits(text) if made else [(c["at"], c["remove"], c["put"] or "") for c in b.column("token_edits")[i].as_py() or []]
                if not changes:
                    pieces = _cut.findall(text)
                    n = sum(map(count, pieces))
                    rows.append((n, n, 0, len(pieces), 0))
                    continue
                tree, again = build(text, count), 0
                before, pieces = tree.tokens, tree.pretokens
                for at, remove, put in changes:
                    tree, n = edit(tree, at, remove, put, count)
                    again += n
                rows.append((before, tree.tokens, len(changes), pieces, again))
            made_of = zip(*rows, strict=True) if rows else ([] for _ in ADDED)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *(pa.array(c, pa.int64()) for c in made_of)], names=[*keep, *ADDED])

    schema = StructType([*(f for f in docs.schema.fields if f.name in keep), *(StructField(n, LongType()) for n in ADDED)])
    return ready.mapInArrow(run, schema)


#: What the query's edits redact: mail addresses and runs of at least six digits, from left to right.
REDACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9]{6,}"
MARK = "[redacted]"
_LOCAL, _DOMAIN, _DIGITS = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), re.compile(r"[0-9]{6,}")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a mark in place of each match of REDACT, each on the result of those before it. An address is found
    by its @, so that long runs without one cost nothing more."""
    out, pos, shift, sign = [], 0, 0, text.find("@")
    digits, mail = _DIGITS.search(text), None
    while True:
        while mail is None and sign >= 0:
            a = sign
            while a > pos and _LOCAL.match(text, a - 1):
                a -= 1
            end = _DOMAIN.match(text, sign + 1) if a < sign else None
            mail, sign = (a, end.end()) if end else None, text.find("@", sign + 1)
        if digits and digits.start() < pos:
            digits = _DIGITS.search(text, pos)
        if digits and (mail is None or digits.start() < mail[0]):
            a, b = digits.span()
        elif mail:
            (a, b), mail = mail, None
        else:
            return out
        out.append((a + shift, b - a, MARK))
        shift, pos = shift + len(MARK) - (b - a), b
        digits = _DIGITS.search(text, pos) if digits and digits.start() < pos else digits
        # What was found ahead may begin in what is now behind.
        if mail and mail[0] < pos:
            sign, mail = text.rfind("@", mail[0], mail[1]), None
        while 0 <= sign < pos:
            sign = text.find("@", sign + 1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_edited(docs, redactions)
