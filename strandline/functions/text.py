"""Tokens, sentences, lemmas and n-grams as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the index (fixed values): a token, a token of the first version, how a word of an n-gram starts, a bracket escape.
TOKEN = r"^[a-z0-9]+[.@&-]*[a-z0-9]+$"
TOKEN_V1 = r"^[a-z0-9.@-]+$"
NGRAM_WORD = r"^[a-z0-9]+[.@&-]*[a-z0-9]+"
BRACKET = r"^-[lr][rsc]b-$"
#: Words never indexed.
STOP_WORDS = tuple(
    """need also play feel felt want n't nt last take go get going long lot little first second third
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is
isn't it it's its itself let's me more most mustn't my myself no nor not of off on one once only or other ought our ours
ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them
themselves then there there's these they they'd they'll they're they've this those through to too under until up very was
wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with
won't would wouldn't you you'd you'll you're you've your yours yourself yourselves two three four five six seven eight nine ten
na ago""".split()
)
_GAP = r"[ \t\r\n]+"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _clean(word: Column) -> Column:
    return F.when(F.regexp_like(word, F.lit(BRACKET)), F.lit("")).otherwise(F.regexp_replace(word, _EDGES, ""))


def raw_tokens(text: Column) -> Column:
    """Lower-cased words between white space, outer punctuation stripped; a word of punctuation alone is empty. Null stays null."""
    return F.transform(F.split(F.lower(text), _GAP), _clean)


def is_token(word: Column, pattern: str = TOKEN) -> Column:
    """A full match that contains a letter and so is no number."""
    return F.regexp_like(word, F.lit(pattern)) & F.regexp_like(word, F.lit("[a-z]"))


def is_stop(word: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return word.isin(*stop)


def keeps(word: Column, pattern: str = TOKEN) -> Column:
    """Whether a word is indexed: a token and no stop word."""
    return is_token(word, pattern) & ~is_stop(word)


def sentences(text: Column) -> Column:
    """The text cut after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n+")


#: Irregular English forms (fixed values): a lemma and its other forms.
IRREGULAR = """
be am is are was were been being; have has had having; do does did done; go goes went gone; say said; get got gotten; make made making
know knew known; think thought; take took taken taking; see saw seen; come came coming; give gave given giving; find found; tell told; become became
leave left; feel felt; bring brought; begin began begun; keep kept; hold held; write wrote written; stand stood; hear heard; mean meant
meet met; run ran; pay paid; sit sat; speak spoke spoken; lead led; grow grew grown; lose lost; fall fell fallen; send sent; build built
draw drew drawn; break broke broken; spend spent; rise rose risen; drive drove driven; buy bought; wear wore worn; choose chose chosen
eat ate eaten; fly flew flown; catch caught; teach taught; sell sold; fight fought; sleep slept; win won; throw threw thrown; sing sang sung
child children; man men; woman women; foot feet; tooth teeth; mouse mice; goose geese; life lives; knife knives; wife wives; leaf leaves
news news; series series; species species; lens lenses; gas gases; bus buses; analysis analyses; add adding; use used using; die died dying; lie lied lying; change changed changing
"""
#: Suffix rules of English, the first that matches counts: a pattern and what it leaves.
LEMMA_RULES = (
    (r"^([a-z]{3,})ies$", r"\1y"),
    (r"^([a-z]*)(sses|shes|ches|xes|zzes)$", None),
    (r"^([a-z]{2,}[^siu])s$", r"\1"),
    (r"^([a-z]{2,})ied$", r"\1y"),
    (r"^([a-z]*[aeiouy][a-z]*)(?:(b)b|(d)d|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)(?:ing|ed)$", r"\1\2\3\4\5\6\7\8\9"),
    (r"^([^aeiouy]+[aiou][bdgkmnprtz])(?:ing|ed)$", r"\1e"),
    (r"^([a-z]*[aeiouy][a-z]*(?:at|iz|is|ur|[^aeioul]l|v|c|u|[aeo]g|dg|rg|[aeiou]s|[^e]as|ar))(?:ing|ed)$", r"\1e"),
    (r"^([a-z]*[aeiouy][a-z]*[a-z])(?:ing|ed)$", r"\1"),
)


def irregular_forms() -> dict[str, str]:
    """Each irregular form and its lemma."""
    entries = [e.split() for line in IRREGULAR.strip().split("\n") for e in line.split(";")]
    return {form: lemma for lemma, *forms in entries for form in forms}


def lemma(word: Column) -> Column:
    """The English lemma of a lower-case word: irregular forms by list, then suffixes by rule; other words stay.

    Plurals (-s, -es, -ies) and verbs (-s, -ed, -ing, with doubled consonants undone and a silent e put back).
    """
    known = F.create_map(*[F.lit(x) for kv in irregular_forms().items() for x in kv])
    out = F.when(known[word].isNotNull(), known[word])
    for pattern, left in LEMMA_RULES:
        value = F.substr(word, F.lit(1), F.length(word) - 2) if left is None else F.regexp_replace(word, pattern, regex.sub(r"\\(\d)", r"$\1", left))
        out = out.when(F.regexp_like(word, F.lit(pattern)), value)
    return out.otherwise(word)


def lemma_sql(word: str) -> str:
    """The same as SQL for DuckDB."""
    known = " ".join(f"WHEN '{form}' THEN '{lemma_}'" for form, lemma_ in irregular_forms().items())
    rules = " ".join(f"WHEN regexp_matches({word}, '{p}') THEN " + (f"{word}[:-3]" if left is None else f"regexp_replace({word}, '{p}', '{left}')") for p, left in LEMMA_RULES)
    return f"coalesce(CASE {word} {known} END, CASE {rules} ELSE {word} END)"


def lemmatiser(model: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A vectorised lemmatiser of the caller's in place of the rules."""
    return F.pandas_udf(model, "string")


def ngram_rows(texts: DataFrame, keep: list[str], words: str, n: int) -> DataFrame:
    """``keep, pos, ngram`` of ``n`` neighbouring words that each begin like a token; others break the chain.

    The word array is zipped with itself, shifted, and exploded once: no lambda, so it stays in generated code.
    """
    shifted = F.arrays_zip(F.col(words).alias("w0"), *[F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))).alias(f"w{i}") for i in range(1, n)])
    rows = texts.select(*keep, F.posexplode(shifted).alias("pos", "_w"))
    parts = [F.col("_w").getField(f"w{i}") for i in range(n)]
    whole = F.lit(True)
    for w in parts:
        whole = whole & F.coalesce(F.regexp_like(w, F.lit(NGRAM_WORD)), F.lit(False))
    return rows.where(whole).select(*keep, "pos", F.concat_ws(" ", *parts).alias("ngram"))


def dictionary_ngrams(texts: DataFrame, keep: list[str], words: str, dictionary: DataFrame, n: int) -> DataFrame:
    """``keep, pos, ngram`` of the n-grams of the word arrays found in ``dictionary(ngram)``; found inside each row, then one semi join."""
    return ngram_rows(texts, keep, words, n).join(dictionary.select("ngram"), "ngram", "left_semi").select(*keep, "pos", "ngram")


def token_rows(texts: DataFrame, keep: list[str], text: str, pattern: str = TOKEN) -> DataFrame:
    """``keep, pos, token``: the indexed words of each text with their place among all its words. Words are cleaned one a row, in generated code."""
    words = texts.select(*keep, F.posexplode(F.split(F.lower(F.col(text)), _GAP)).alias("pos", "token"))
    return words.withColumn("token", _clean(F.col("token"))).where(keeps(F.col("token"), pattern))


def query_terms(query: str, dictionary: Callable[[list[str]], set[str]] | set[str], stop: tuple[str, ...] = STOP_WORDS) -> list[str]:
    """Terms of a search: dictionary bigrams and trigrams of all its words, then its single words without stop words.

    Words are cleaned as those of the index are. ``dictionary`` is a set of n-grams, or a function
    that picks the known ones of a few candidates.
    """
    words = [regex.sub(_EDGES, "", "" if regex.match(BRACKET, w) else w) for w in regex.split(_GAP, query.lower())]
    runs = [words[i : i + n] for n in (2, 3) for i in range(len(words) - n + 1)]
    grams = [" ".join(r) for r in runs if all(regex.match(NGRAM_WORD, w) for w in r)]
    known = dictionary(grams) if callable(dictionary) else dictionary
    single = [w for w in words if regex.fullmatch(TOKEN, w) and regex.search("[a-z]", w) and w not in stop]
    return list(dict.fromkeys([g for g in grams if g in known] + single))
