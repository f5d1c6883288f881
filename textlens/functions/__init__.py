from . import charclass, lexicons, text  # noqa: F401
from .text import (  # noqa: F401
    anonymize_mentions, case_by_flags, chat_messages, clean_text, collapse_spaces,
    drop_retweet, expand_contractions, format_template, is_lower, is_upper,
    join_words, remove_stopwords, replace_punctuation, strip_emoji, strip_entities,
    strip_leading_mentions, tfidf_tokens, unify_user, word_count, word_tokenize,
    words, words_match,
)
