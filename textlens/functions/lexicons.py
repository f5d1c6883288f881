"""Fixed values the jobs must share with the behaviour they reproduce.

Everything here is data, not logic: word lists, prompt texts and suffix
rules.  Jobs take them as parameters, so callers can pass their own lists.
"""

# --- fixed values: English stopword list (179 entries, published NLTK list) ---
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't "
    "ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# --- fixed values: common English contractions (form -> expansion) ---
CONTRACTIONS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot",
    "could've": "could have", "couldn't": "could not", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not",
    "hasn't": "has not", "haven't": "have not", "he'd": "he would",
    "he'll": "he will", "he's": "he is", "how'd": "how did", "how's": "how is",
    "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have",
    "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "might've": "might have", "mightn't": "might not",
    "must've": "must have", "mustn't": "must not", "needn't": "need not",
    "shan't": "shall not", "she'd": "she would", "she'll": "she will",
    "she's": "she is", "should've": "should have", "shouldn't": "should not",
    "that's": "that is", "there's": "there is", "they'd": "they would",
    "they'll": "they will", "they're": "they are", "they've": "they have",
    "wasn't": "was not", "we'd": "we would", "we'll": "we will",
    "we're": "we are", "we've": "we have", "weren't": "were not",
    "what's": "what is", "where's": "where is", "who's": "who is",
    "won't": "will not", "would've": "would have", "wouldn't": "would not",
    "y'all": "you all", "you'd": "you would", "you'll": "you will",
    "you're": "you are", "you've": "you have",
}

# --- fixed values: fused forms the word tokenizer splits in two ---
FUSED_FORMS = {
    "cannot": "can not", "gimme": "gim me", "gonna": "gon na",
    "gotta": "got ta", "lemme": "lem me", "wanna": "wan na",
}

# --- fixed values: noun suffix rules of the dictionary lemmatizer ---
NOUN_SUFFIX_RULES = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)

# --- fixed values: chat record texts (training side) ---
TRAIN_SYSTEM_MESSAGE = "An accurate hate speech detector used for research purposes."
TRAIN_PROMPT_TEMPLATE = """
    You will be asigned a task:

    1) You will get one sentence as input.
    2) I want you to identify hatefull speech.
    3) Return ONLY the sentence with hatefull part CAPITALIZED.

    Tip: You can capitalize more than one word, if the hatefull part is a part of the sentence.

    Note: This prompt is for research purposes only, and the model is not intended to be used for any other purpose.

    Sentence: {text}
"""

# --- fixed values: chat request texts (prediction side) ---
PREDICT_SYSTEM_MESSAGE = "ChatGPT is an accurate hate speech detector."
PREDICT_PROMPT_TEMPLATE = """
            You will be asigned a task:

            1) You will get one sentence as input.
            2) I want you to identify hatefull speech.
            3) Return ONLY the sentence with hatefull part CAPITALIZED.

            Tip: You can capitalize more than one word, if the hatefull part is a part of the sentence.

            Sentence: {text}
        """

# --- fixed values: annotator label meaning "hate speech" ---
HATE_LABEL = "hatespeech"
