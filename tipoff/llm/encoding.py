"""Token ids of whole texts from a vocabulary file, and splicing of overlapping chunks of huge ones."""

import bisect
import json
import re

CHUNK = 1 << 16
OVERLAP = 1 << 9
BATCH_CHARS = 1 << 18

# Characters on whose class every Unicode version agrees; other texts take the vocabulary's own library.
_SETTLED = "[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]"


def read_vocabulary(path: str) -> tuple[str, bytes]:
    """(kind, content) of a vocabulary file, to be shipped to the tasks."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "model"):
        raise ValueError(f"{path}: a .json or .model vocabulary is needed")
    with open(path, "rb") as file:
        return kind, file.read()


def _byte_alphabet():
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, others follow 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as the vocabulary's library gives them, without added special tokens."""

    def __init__(self, kind: str, content: bytes):
        self.spaces_split = False
        self._fast, self._rare = None, re.compile(_SETTLED)
        if kind == "model":
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.size = self._pieces.get_piece_size()
            return
        from tokenizers import Tokenizer

        self._pieces = None
        self._library = Tokenizer.from_buffer(content)
        self._library.no_truncation()
        self._library.no_padding()
        self.size = self._library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = (
            spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        )
        #: A single space between visible characters always begins a new piece, whatever surrounds it.
        self.spaces_split = plain and all(
            not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in added
        )
        if self.spaces_split and not spec["model"].get("unk_token") and not spec["model"].get("ignore_merges"):
            self._fast = self._ranked(spec, added)

    @staticmethod
    def _ranked(spec, added):
        """The same vocabulary by rank, where ids follow the order of merges; else None."""
        import tiktoken

        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in w): i for w, i in vocabulary.items() if w not in special}
        if len(ranks) != 256 + len(pairs):
            return None
        # Fixed value: the pattern of byte-level pre-tokenisation.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def library_ids(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[list[int]]:
        """Ids by the vocabulary's own library; huge texts are spliced from overlapping chunks."""
        if self._pieces is not None:
            return self._pieces.encode(texts, num_threads=1) if texts else []
        out: list = [None] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= chunk or not self.spaces_split]
        for at in _batches(small, texts):
            for i, e in zip(at, self._library.encode_batch_fast([texts[i] for i in at], add_special_tokens=False)):
                out[i] = e.ids
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = splice(self._with_offsets, text, chunk, overlap)
        return out

    def _with_offsets(self, text: str):
        found = self._library.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def ids(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[list[int]]:
        """The same ids, by the ranked form of the vocabulary wherever both agree by construction."""
        if self._fast is None:
            return self.library_ids(texts, chunk, overlap)
        fast = [len(t) <= chunk and not self._rare.search(t) for t in texts]
        rest = iter(self.library_ids([t for t, f in zip(texts, fast) if not f], chunk, overlap))
        return [self._fast.encode(t, allowed_special="all") if f else next(rest) for t, f in zip(texts, fast)]


def _batches(places, texts):
    """Lists of places whose texts have about BATCH_CHARS characters together."""
    batch, size = [], 0
    for i in places:
        batch.append(i)
        size += len(texts[i])
        if size >= BATCH_CHARS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def stable_boundary(text: str, start: int, end: int) -> int | None:
    """The first place in [start, end) where a piece begins in any context, or None.

    There a single space stands between two visible characters. No piece can
    hold a space behind a visible character, so one ends before it and one
    begins with it, and all that follows depends on the text from there alone.
    """
    at = text.find(" ", max(start, 1), end)
    while at >= 0:
        if at + 1 < min(end, len(text)) and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at = text.find(" ", at + 1, end)
    return None


def splice(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of ``text`` from overlapping chunks; ``encode(part)`` gives (ids, offsets).

    Neighbouring chunks are joined where both have a token boundary at the same
    stable place of their overlap. Where there is none the overlap doubles, and
    once it covers the whole left chunk that chunk grows.
    """
    n, out = len(text), []
    start, end = 0, min(len(text), chunk)
    ids, offsets = encode(text[start:end])
    first = 0  # tokens of the left chunk that are already out
    while end < n:
        width, seam = overlap, None
        while seam is None and width < end - start:
            right = end - width
            stop = min(n, right + chunk)
            if stop > end:
                at = stable_boundary(text, right + 1, end - 1)
                if at is not None:
                    right_ids, right_offsets = encode(text[right:stop])
                    cut, right_cut = _token_at(offsets, at - start), _token_at(right_offsets, at - right)
                    if cut is not None and right_cut is not None and cut >= first:
                        seam = (cut, right_cut)
                        break
            width *= 2
        if seam is None:  # the left chunk has no place to cut: take a longer one
            end = min(n, end + max(chunk, end - start))
            ids, offsets = encode(text[start:end])
            continue
        out += ids[first:seam[0]]
        start, end, ids, offsets, first = right, stop, right_ids, right_offsets, seam[1]
    return out + ids[first:]


def _token_at(offsets, at: int) -> int | None:
    """Index of the token that begins at ``at`` (its space may be trimmed off), or None if one spans it."""
    i = bisect.bisect_right(offsets, at, key=lambda o: o[1])
    return i if i < len(offsets) and offsets[i][0] in (at, at + 1) else None
