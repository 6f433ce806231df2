"""Text analysis as columns: cleaning, tokens, stop words, product names."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that cleaning takes out.
PUNCTUATION = string.punctuation
#: A web address in running text.
URL = r"https?://[^ \t\n\r\f]+"
# Fixed value: an address of any scheme, up to the end of its path. Word characters are those of any script.
ANY_URL = r"[\p{L}\p{N}_]+://[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)*(/[^\s/]*)*"
# The same addresses: one begins where its word does, so no word is tried again from its other letters.
_ANY_URL = r"(?<![\p{L}\p{N}_])" + ANY_URL.replace("+://", "++://", 1)
#: Characters that part words, besides the space.
BLANKS = "\t\n\r\f"

#: English function words that are not indexed.
STOPWORDS = tuple(
    """a about above after again all am an and any are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers him his how
    i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she
    should so some such than that the their them then there these they this those through to too under until up very
    was we were what when where which while who whom why will with would you your""".split()
)


def clean(text: Column, any_scheme: bool = False) -> Column:
    """Text without web addresses (of http and https, or of any scheme) and ASCII punctuation."""
    kept = F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, _ANY_URL if any_scheme else URL, "")).otherwise(text)
    return F.translate(kept, PUNCTUATION, "")


def spaced(text: Column, lower: bool = True) -> Column:
    """A text without punctuation, its words parted by one space or more. Null gives an empty text."""
    return F.translate(F.coalesce(F.lower(text) if lower else text, F.lit("")), BLANKS + PUNCTUATION, " " * len(BLANKS))


def tokens(text: Column, lower: bool = True) -> Column:
    """Words of a text without punctuation. Null gives an empty list."""
    return F.array_remove(F.split(spaced(text, lower), " "), "")


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def indexable(word: Column) -> Column:
    """Words worth a posting: longer than three letters, not a number, not a stop word."""
    return (F.length(word) > 3) & ~word.rlike("^[0-9]+$") & ~word.isin(*STOPWORDS)


def raw_query(text: Column) -> Column:
    """A question as a query: its words but stop words (case counts), joined by '+'."""
    words = F.filter(F.split(text, " ", -1), lambda w: ~w.isin(*STOPWORDS))
    return F.array_join(words, "+")


def mentions_any_word(text: Column, phrase: Column) -> Column:
    """Whether any word of a phrase occurs in a text, as a substring, case aside."""
    return F.exists(F.split(F.lower(phrase), " "), lambda w: F.contains(F.lower(text), w))


def detected_product(question: Column, products: Column) -> Column:
    """The product that a question names: its first word that is a product's whole name, case aside; else null.

    products is an array of names, in the order of their lists; names are lower-cased in the result.
    """
    names = F.transform(products, lambda n: F.lower(n))
    words = F.filter(F.split(F.lower(question), r"\s+"), lambda w: (w != "") & F.array_contains(names, w))
    return F.get(words, F.lit(0))


def query_terms(question: str, lower: bool = True) -> list[str]:
    """Distinct words of a question without stop words, in order; the driver's side of tokens()."""
    plain = (question.lower() if lower else question).translate(str.maketrans("", "", PUNCTUATION))
    return list(dict.fromkeys(w for w in plain.split() if w not in STOPWORDS))


def duck_tokens(column: str) -> str:
    """tokens() in DuckDB SQL."""
    marks = PUNCTUATION.replace("'", "''")
    plain = f"translate(lower(coalesce({column}, '')), '{marks}', '')"
    return rf"list_filter(string_split(trim(regexp_replace({plain}, '[ \t\n\r\f]+', ' ', 'g')), ' '), lambda w: w <> '')"


def duck_stopwords() -> str:
    return ", ".join(f"'{w}'" for w in STOPWORDS)
