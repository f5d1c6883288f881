from textlens.llm import tokens as TK


def test_cache_stays_small_and_right():
    """Texts of more words than it takes: the cache stays within some 60 MB, and values stay right."""
    cache = TK.PreTokenCache(TK.vocabulary_path(), TK.ids_bytes)
    for at in range(0, 250_000, 1_000):
        cache.values(" ".join(f"w{i}" for i in range(at, at + 1_000)))
    assert len(cache.kept) <= 201_000
    assert b"".join(cache.values("w1 w249999 new")) == TK.ids_bytes(cache.library.encode("w1 w249999 new", add_special_tokens=False).ids)
