"""Portable regex character classes.

Both Java regex (Spark) and RE2 (the DuckDB oracle) accept these strings
unchanged, so one definition serves the jobs and their SQL checks.  Bare
``\\w``/``\\s``/``\\b`` are never used: their meaning differs between the
engines and from Python's Unicode-aware defaults.
"""

# Python ``\w``: letters, digits and underscore in any script.
WORD_INNER = r"\p{L}\p{N}_"
WORD = f"[{WORD_INNER}]"
NOT_WORD = f"[^{WORD_INNER}]"

# Python ``\s`` / ``str.split()`` whitespace, listed code point by code point.
SPACE_INNER = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE = f"[{SPACE_INNER}]"
# The same characters listed literally, without the ASCII space itself.
OTHER_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
                     + "".join(chr(c) for c in range(0x2000, 0x200B))
                     + "\u2028\u2029\u202f\u205f\u3000")
SPACES = SPACE + "+"

# The emoji/symbol class removed by the cleaner.  The listed ranges overlap
# into this union: a few BMP singletons plus everything from U+24C2 upwards.
EMOJI_INNER = r"\x{200d}\x{231a}\x{23cf}\x{23e9}\x{24c2}-\x{10ffff}"
EMOJI = f"[{EMOJI_INNER}]"

# Fixed patterns of the cleaning steps.
MENTION = f"@{WORD}+"
HTML_ENTITY = r"&[#A-Za-z0-9]+;"
URL = r"http[s]?://"
# Anything that is not a word char, whitespace or '@' becomes a space.
PUNCT = f"[^{WORD_INNER}@{SPACE_INNER}]"
# Leading '@user' / '@user:' runs (with the spaces around them) and trailing
# spaces: one pass reaches the fixed point of the recursive strip.
LEADING_MENTIONS = f"^(?:{SPACE}*@user:?)*{SPACE}*|{SPACE}+\\z"
# Word-level token pattern of the TF-IDF vectoriser: runs of 2+ word chars.
TOKEN2 = f"{WORD}{{2,}}"
