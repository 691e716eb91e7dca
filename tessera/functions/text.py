"""Text analysis: tokens, stopwords, title emphasis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Fixed value: what ends the opening sentence, and how much of a text without such an end is its title.
SENTENCE_END, TITLE_CHARS = r"[.!?\n]", 120

#: The stopwords, tested on tokens before stemming.
STOPWORDS = """
a about above after again against all am an and any are as at
be because been before being below between both but by
can cannot could did do does doing down during each few for from further
had has have having he her here hers herself him himself his how
i if in into is it its itself just me more most my myself
no nor not now of off on once only or other our ours ourselves out over own
same she should so some such
than that the their theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who whom why will with would
you your yours yourself yourselves
""".split()


def tokenize(text: Column) -> Column:
    """Array of the runs of a-z and 0-9 in the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def boost_title(text: Column, boost: int) -> Column:
    """The text with its title appended ``boost`` - 1 times.

    The title is what precedes the first sentence end, or the first 120
    characters where there is none.  A boost up to 1, or an empty title, leaves
    the text as it is.
    """
    if boost <= 1:
        return text
    title = F.when(F.regexp_like(text, F.lit(SENTENCE_END)), F.split(text, SENTENCE_END, 2)[0]).otherwise(F.substring(text, 1, TITLE_CHARS))
    return F.when(title == "", text).otherwise(F.concat(text, F.repeat(F.concat(F.lit(" "), title), boost - 1)))
