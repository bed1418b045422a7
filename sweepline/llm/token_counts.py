"""Token counts under a unigram tokenizer, by dynamic programming on a trie of pre-tokens.

A pre-token is a run of characters that aren't ASCII white space, after a word mark. The best segmentation of a
word into vocabulary pieces depends, at each place, only on the characters before it; words that share a prefix
share these forward scores. So the distinct pre-tokens of a batch go into one trie, a node's best score and piece
count are worked out once, and a node that ends a word holds that word's count. Documents then only look words up.
Words enter the trie in sorted order, which is its depth-first order: only the branch to the last word is held, and of
it ``DEEPEST`` nodes, so memory goes neither with the number of nodes nor with the longest word. A node also holds where in the trie of pieces the pieces
stand that are still open there, so each new character costs a step for each open piece.

The vocabulary is that of a public tokenizer file (a parameter). The file ranks its pieces but has no
probabilities; a piece's score is Zipf's law over its rank. Characters that no piece covers cost one token for
each UTF-8 byte. Between equal scores the segmentation with fewer tokens counts.

Nulls: a null text is an empty one and has no tokens; a null ``doc_id`` is passed on. Repeated rows each give a
row. Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, distinct_words, map_batches, sums, table

MARK = "▁"
#: Words whose counts a task keeps from batch to batch, and their longest; it then begins anew. Bounds memory, changes no count.
KEPT_WORDS, KEPT_LENGTH = 500_000, 64
#: Nodes of a branch that are held; what follows in a longer word is worked out with its last node alone, and anew for each such word.
DEEPEST = 4096


def zipf_pieces(model_path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece file with log-probabilities by Zipf's law over their order in it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 3) for r in range(len(pieces))))
    return {p: -math.log(r + 3) - total for r, p in enumerate(pieces)}


def piece_trie(pieces: dict[str, float]) -> dict[str, list]:
    """The vocabulary by characters: character -> [score of the piece that ends here or None, what follows]."""
    top: dict[str, list] = {}
    for piece, score in pieces.items():
        below, node = top, None
        for char in piece:
            node = below.setdefault(char, [None, {}])
            below = node[1]
        if node is not None:
            node[0] = score
    return top


class PreTokenTrie:
    """Token counts and scores of words; those of a shared prefix are worked out once for each sorted batch of words."""

    def __init__(self, pieces: dict[str, float], byte_penalty: float = 10.0):
        self.pieces = piece_trie(pieces)
        self.byte_score = min(pieces.values(), default=0.0) - byte_penalty

    def count(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """word -> (tokens, score) of distinct words."""
        pieces, byte_score = self.pieces, self.byte_score
        # The branch to the last word: for each node its best score and count, and the open pieces: what may follow, score and count before.
        branch: list[tuple[float, int, list]] = [(0.0, 0, [])]
        ends, last = {}, ""
        for word in sorted(words):
            text = MARK + word
            same = 0
            for x, y in zip(text[:DEEPEST], last, strict=False):
                if x != y:
                    break
                same += 1
            del branch[same + 1 :]
            node = branch[-1]
            for part, held in ((text[same:DEEPEST], True), (text[DEEPEST:], False)):
                for char in part:
                    score, count, open_ = node
                    n = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
                    best, tokens, still = score + byte_score * n, count + n, []
                    for follows, s, c in (*open_, (pieces, score, count)):
                        below = follows.get(char)
                        if below is not None:
                            own, deeper = below
                            if own is not None:
                                own += s
                                if own > best or (own == best and c + 1 < tokens):
                                    best, tokens = own, c + 1
                            if deeper:
                                still.append((deeper, s, c))
                    node = (best, tokens, still)
                    if held:
                        branch.append(node)
            ends[word], last = (node[1], node[0]), text[:DEEPEST]
        return ends


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens, log_prob (sum of the best segmentations' scores); see the module's text."""
    if model_path is None:
        import public_tokenizers

        model_path = str(public_tokenizers.path("piece_bpe_32k.model"))

    def run(batches):
        trie, known = PreTokenTrie(zipf_pieces(model_path)), {}
        for batch in arrow_slices(batches):
            words, codes, offsets = distinct_words(batch.column("text"))
            words = words.to_numpy(zero_copy_only=False).tolist()
            if len(known) > KEPT_WORDS:
                known = {}
            fresh = [w for w in words if w not in known]
            found = trie.count(fresh)
            known.update(item for item in found.items() if len(item[0]) <= KEPT_LENGTH)
            ends = [found.get(w) or known[w] for w in words]
            tokens = np.fromiter((c for c, _ in ends), np.int64, len(ends))[codes]
            scores = np.fromiter((s for _, s in ends), np.float64, len(ends))[codes]
            yield {"doc_id": batch.column("doc_id"), "n_words": np.diff(offsets), "n_tokens": sums(tokens, offsets), "log_prob": sums(scores, offsets)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, n_tokens long, log_prob double")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
