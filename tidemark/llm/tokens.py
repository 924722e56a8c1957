"""Token ids of whole texts, by a public tokenizer file, with the ids of common words remembered."""

from __future__ import annotations

import numpy as np

_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class WordTokenizer:
    """ids of a text under a word-end BPE file of the ``tokenizers`` library.

    Such a tokenizer drops white space and never merges across it, so a text's ids are those of its
    words in order. ``white_space_splits`` says that the file is of this kind; texts that hold control
    separators or the start of a special token go through the library whole, as do all texts otherwise.
    """

    def __init__(self, path: str, white_space_splits: bool = True, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.split, self.limit, self.known = white_space_splits, limit, {}

    def _learn(self, words: list[str]) -> None:
        """Encode new words, many at once; a token belongs to the word in which it starts."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            found = self.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            ids = np.array(found.ids, "<u4")
            begins = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            cuts, ids = (4 * np.searchsorted(begins, starts)).tolist(), ids.tobytes()
            for w, a, b in zip(part, cuts, cuts[1:], strict=False):
                self.known[w] = ids[a:b]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, without special tokens."""
        get, out, new, open_ = self.known.get, [], {}, []
        for t in texts:
            words = self._words(t)
            if words is None:
                out.append([np.array(self.encode(t, add_special_tokens=False).ids, "<u4").tobytes()])
                continue
            found = list(map(get, words))
            if None in found:
                gaps = [(i, words[i]) for i, x in enumerate(found) if x is None]
                new.update(dict.fromkeys(w for _, w in gaps))
                open_.append((found, gaps))
            out.append(found)
        if new:
            self._learn(list(new))
            for found, gaps in open_:
                for i, w in gaps:
                    found[i] = self.known[w]
            if len(self.known) > self.limit:  # the words met first stay, being the common ones
                for w in new:
                    del self.known[w]
        return [np.frombuffer(b"".join(x), "<u4") for x in out]

    def _words(self, text: str) -> list[str] | None:
        if not self.split or any(x in text for x in _ODD):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.lower().split()  # up to U+00FF, case folding and composition change nothing else


_held: dict[tuple[str, bool], WordTokenizer] = {}


def word_tokenizer(path: str, white_space_splits: bool = True) -> WordTokenizer:
    """The worker's own tokenizer for a file: what it has learnt serves its later tasks too."""
    if (path, white_space_splits) not in _held:
        _held[path, white_space_splits] = WordTokenizer(path, white_space_splits)
    return _held[path, white_space_splits]


def default_tokenizer() -> str:
    """Path of the public word-end BPE vocabulary; any file of the tokenizers library will do instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
