"""Pre-tokens that a worker's cache does not hold."""

from textlens.llm import tokens as TK


def test_misses_of_a_text_are_encoded_together():
    cache = TK.PreTokenCache(TK.vocabulary_path(), TK.ids_bytes)
    calls, fast = [], cache.fast

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return fast.encode_ordinary(text)
    cache.fast = Counted()
    text = " ".join(f"Unseen{i},\n\nx{i}é" for i in range(300))
    want = TK.ids_bytes(cache.library.encode(text, add_special_tokens=False).ids)
    assert b"".join(cache.values(text)) == want and len(calls) <= 2
    assert b"".join(cache.values(text)) == want   # now from the cache


def test_texts_equal_the_library():
    texts = ["a\n b", "  x", "a  b", "w 中 b é c", "a　 b", "x\t y", "<|endoftext|> a", " ", "a ", "é  b", "a ́b c",
             " 12 3\n\n 4", "tail\n next\r\n 1 ...", "a\x00 b\x00", "Ġ Ġx Ġ"]
    cache = TK.PreTokenCache(TK.vocabulary_path(), TK.ids_bytes)
    counts = TK.PreTokenCache(TK.vocabulary_path(), len)
    for text in texts:
        ids = cache.library.encode(text, add_special_tokens=False).ids
        assert b"".join(cache.values(text)) == TK.ids_bytes(ids)
        assert sum(counts.values(text)) == len(ids)
