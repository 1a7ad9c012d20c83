"""Word lists and rules that results depend on."""

# Words that carry no topic in relevance search.
SEARCH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "for", "from", "had", "has", "have", "he", "in", "into", "is", "it", "its", "of", "on", "or",
    "she", "than", "that", "the", "their", "them", "there", "these", "they", "this", "those", "to", "was", "were", "will", "with",
)
# After these words a single letter is part of the name.
LETTER_CONTEXTS = {"vitamin": ("a", "b", "c"), "hepatitis": ("b", "c")}
# Letters that name cells before "cell" and "cells".
CELL_LETTERS = ("b", "t")
CELL_WORDS = ("cell", "cells")

# Function words that corpus analysis leaves out in its conditions C and D. Negations stay in.
ANALYSIS_STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "either", "else", "few", "for", "from", "further", "had", "has", "have", "having", "he",
    "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "may", "me", "might", "more", "most", "much",
    "must", "my", "myself", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "upon", "us",
    "very", "was", "we", "were", "what", "when", "where", "whether", "which", "while", "who", "whom", "whose", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves",
)
# Terms that a selection of analysis terms always shows where they occur.
SELECTED_DOMAIN_TERMS = (
    "agonist", "diabetes", "glp", "glp-1", "glp-1ra", "glp-1ras", "glucagon-like", "glucose", "il6", "insulin", "no", "not", "obesity",
    "patients", "peptide-1", "receptor", "semaglutide", "treatment", "without", "β-cells",
)
# Terms that the short comparison prefers, in this order.
REPRESENTATIVE_TERMS = ("and", "the", "receptor", "glp-1", "semaglutide", "insulin", "not", "no", "without", "il6", "pathway-specific", "endotyping")


def check_stopwords(words: tuple[str, ...]) -> tuple[str, ...]:
    """A stopword list must be unique, lower-case and alphabetic, and keep negations in the text."""
    if len(set(words)) != len(words) or any(w != w.lower() or not w.isalpha() for w in words):
        raise ValueError("stopwords must be unique lower-case words")
    if {"no", "not", "without"} & set(words):
        raise ValueError("stopwords must not hold negations")
    return words
