"""Where the public tokenizers' files are.  Paths are parameters of the
operators; these are the defaults of the registered queries."""

from __future__ import annotations

BYTE_BPE = "byte_bpe_50k.json"
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pattern() -> str:
    """The pattern that cuts a text into pre-tokens."""
    import public_tokenizers
    return public_tokenizers.PATTERN


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes are themselves, the others follow
    from code point 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


def mapper():
    """A function that writes a text's UTF-8 bytes as these characters."""
    table = byte_chars()

    def mapped(text: str) -> str:
        if text.isascii() and text.isprintable():  # printable ASCII stands for itself, but for the space
            return text.replace(" ", table[32])
        return text.encode("utf-8").decode("latin-1").translate(table)

    return mapped
