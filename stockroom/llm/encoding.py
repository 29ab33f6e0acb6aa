"""Token ids of whole texts as the ``tokenizers`` library gives them.

``tokenizers`` encodes about 1.3 MB of text a second and core, ``tiktoken`` four times that, and for a
byte-level BPE both apply the same merges to the same pieces. So where a tokenizer file is such a BPE
whose merges follow the order of its ids, its own vocabulary is handed to ``tiktoken``; strings of added
tokens inside a text become their ids, as ``tokenizers`` does by default. Any other file goes to
``tokenizers``, and so does any single text that ``tiktoken`` refuses: its patterns give up on runs of
about a million white-space signs.
"""

from __future__ import annotations

import json
import os

#: Pre-tokenisation pattern of the byte-level BPE that tokenizers' ByteLevel splits by (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, "Encoder"] = {}


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast = self._same_bpe(json.load(file))

    @staticmethod
    def _same_bpe(spec: dict):
        """A tiktoken encoding with this file's vocabulary, or None where results could differ."""
        before, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        plain = (
            spec.get("normalizer") is None
            and (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space", True)) == ("ByteLevel", True, False)
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
        )
        if not plain:
            return None
        special = {x["content"]: x["id"] for x in added}
        signs, vocab = _bytes_of_signs(), {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get("".join(m), -1) for m in merges]
        if made != sorted(set(made)) or len(made) + 256 != len(vocab) or any(c not in signs for t in vocab for c in t):
            return None
        import tiktoken

        return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks={bytes(signs[c] for c in t): i for t, i in vocab.items()}, special_tokens=special)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null has those of the empty text."""
        return [self._ids(t or "") for t in texts]

    def _ids(self, text: str) -> bytes:
        import numpy as np

        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # "max stack size exceeded": the text's pattern, not the text, is at fault
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
