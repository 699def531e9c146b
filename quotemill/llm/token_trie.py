"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens. The distinct pre-tokens of many documents form a trie of their bytes;
the best score of every prefix is computed once, from the nodes above it, with the number of tokens
of that best path. A pre-token's count is that of its last node and is remembered; a document's
count is the sum over its pre-tokens. No row is shuffled.

The model: the pieces of a public vocabulary, scored by rank as a Zipf law, log p = -ln(rank + 2).
The best segmentation has the largest sum; of equal sums, the fewest tokens.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, words, numbers and marks with the blank before them; runs of white space.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents and bytes of text whose pre-tokens are walked together, and pre-token counts that a task remembers.
WALKED_DOCS, WALKED_BYTES, REMEMBERED = 512, 8 << 20, 300_000


def load_scores(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece -> log score, from a file of base64 pieces and ranks. Every single byte must be a piece."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary doesn't hold every byte")
    return {piece: -math.log(rank + 2) for piece, rank in ranks.items()}


class TrieWalk:
    """Token counts of pre-tokens by a depth-first walk over their trie.

    Sorted pre-tokens come in the order in which such a walk meets the ends of their paths. The stack
    holds best score and token count of every prefix on the current path: going on to the next
    pre-token drops what it doesn't share and computes only its new nodes. So each node of the trie
    is computed once, and memory is that of one path.
    """

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        lengths: dict[bytes, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {tail: sorted(n) for tail, n in lengths.items()}  # lengths of the pieces with this end

    def tokens(self, ordered: list[bytes]) -> list[int]:
        """The token count of each pre-token; they must be sorted."""
        scores, lengths = self.scores, self.lengths
        best, count, path, out = [0.0], [0], b"", []
        for token in ordered:
            shared = 0
            for shared, (x, y) in enumerate(zip(path, token, strict=False)):
                if x != y:
                    break
            else:
                shared = min(len(path), len(token))
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                top, fewest = best[end - 1] + scores[token[end - 1 : end]], count[end - 1] + 1
                for n in lengths.get(token[end - 2 : end], ()) if end > 1 else ():
                    if n > end:
                        break
                    s = scores.get(token[end - n : end])
                    if s is not None:
                        s += best[end - n]
                        if s > top or (s == top and count[end - n] + 1 < fewest):
                            top, fewest = s, count[end - n] + 1
                best.append(top)
                count.append(fewest)
            path = token
            out.append(count[-1])
        return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most WALKED_DOCS rows and, unless a single text is longer, WALKED_BYTES of text."""
    at = size = 0
    for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
        if row - at == WALKED_DOCS or (row > at and size + n > WALKED_BYTES):
            yield batch.slice(at, row - at)
            at, size = row, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


def count_tokens(docs: DataFrame, scores: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text", pattern: str = PRE_TOKEN) -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_distinct, n_tokens) per row of `docs`.

    A null or empty text has zeros. Repeated rows are counted each on their own; a null id stays
    null. Whole texts are counted; a pre-token of any length is. Equal scores go to fewer tokens. An
    empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scores)  # bounded by the vocabulary file
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, cut = TrieWalk(sent.value), regex.compile(pattern)
        known: dict[str, int] = {}
        for batch in batches:
            for part in _slices(batch):
                texts = part.column("text").to_pylist()
                counts = [Counter(cut.findall(text)) for text in texts]
                if len(known) > REMEMBERED:
                    known.clear()
                new = sorted((t.encode(), t) for t in set().union(*counts).difference(known))
                known.update(zip((t for _, t in new), walk.tokens([b for b, _ in new]), strict=True))
                totals = [sum(known[t] * n for t, n in c.items()) for c in counts]
                columns = [[len(t.encode()) for t in texts], [c.total() for c in counts], [len(c) for c in counts], totals]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_bytes", "n_pretokens", "n_distinct", "n_tokens"]
                )

    return rows.mapInArrow(scan, "doc_id long, n_bytes long, n_pretokens long, n_distinct long, n_tokens long")


def token_report(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return count_tokens(docs, load_scores(path))
