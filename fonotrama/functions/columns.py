"""Text and phoneme functions as Column expressions (all native), and Arrow wrappers of the Python kernels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel, normalise, spelling

# Tokens, marks of a pause, vowels, voiced consonants, and words of a text.
TOKEN = r"[\p{L}\p{M}'-]+|[;:,.!?—…\"«»“”(){}₹\[\]]|\s+"
PAUSE = r"[;:,.!?¡¿—…\"«»“”(){}₹\[\]]"
VOWELS = "aeoáéóâêôãõàiuíúïü"
VOICED = "bdgjlmnrvz"
WORD = r"[\p{L}\p{N}_'-]+"
#: Composed letters and their decompositions, by rule: a vowel, c or n with a mark that may stand on it.
COMPOSED = {
    unicodedata.normalize("NFC", base + mark): base + mark
    for mark, bases in (("\u0300", "aeiou"), ("\u0301", "aeiouy"), ("\u0302", "aeiou"), ("\u0303", "aeinou"), ("\u0308", "aeiouy"), ("\u0327", "c"))
    for base in bases + bases.upper()
}
#: Ranges that all composed letters lie in; quicker to search for than the letters.
COMPOSED_RANGES = "[\u00c0-\u017f\u1e00-\u1eff]"


# --- normalisation steps that need no callback (NRM2-6, 23, 24) ---------------------------------------------


def plain_characters(c: Column) -> Column:
    """Quotes, dashes and odd spaces to their plain forms."""
    return F.replace(F.translate(c, "‘’ʼ“”«»–—−\t\f\v ​", "'''\"\"\"\"———     "), F.lit("…"), F.lit("..."))


def symbol_words(c: Column) -> Column:
    for sign, word in normalise.SYMBOLS:
        c = F.replace(c, F.lit(sign), F.lit(f" {word} " if word else " "))
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalise.normalise(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else normalise.sentences(t))


def ipa_by(rules: kernel.Rules):
    """The rules' reading of words, each distinct word of a batch worked out once and remembered by the worker."""

    @F.pandas_udf(T.StringType())
    def read(words: pd.Series) -> pd.Series:
        return words.map({w: kernel.word_ipa(w, rules) for w in words.dropna().unique()})

    return read


word_ipa = ipa_by(kernel.SEED)


SYLLABLES = T.ArrayType(T.StructType([*(T.StructField(n, T.ArrayType(T.StringType())) for n in ("onset", "nucleus", "coda")), *(T.StructField(n, T.BooleanType()) for n in ("stressed", "secondary"))]))


@F.pandas_udf(SYLLABLES)
def syllables(words: pd.Series) -> pd.Series:
    held = {w: kernel.syllable_rows(w) for w in words.dropna().unique()}
    return words.map(lambda w: held.get(w))


# --- words ----------------------------------------------------------------------------------------------------


def vowelless(word: Column) -> Column:
    """2 to 6 letters, none a vowel (NRM26)."""
    low = F.lower(word)
    return low.rlike(r"^\p{IsAlphabetic}{2,6}$") & ~low.rlike("[aeiouáéíóúâêôãõàü]")


def needs_normalising(word: Column) -> Column:
    return word.rlike(r"\P{IsAlphabetic}") | F.lower(word).isin(*normalise.ABBREVIATIONS) | vowelless(word)


def sounded_u(word: Column, rules: kernel.Rules = kernel.SEED) -> Column:
    """Whether a u after q or g sounds (TR1)."""
    marked = F.regexp_replace(word, f"([qg])u(?=[{kernel.BEFORE_FRONT}])", "$1ü")
    return (marked != word) & (marked.isin(*sorted(rules.sounded_words)) | marked.rlike("|".join(rules.sounded_stems)))


def ks_stem(word: Column) -> Column:
    bare = F.regexp_replace(F.translate(F.lower(word), "".join(COMPOSED), "".join(v[0] for v in COMPOSED.values())), "[\u0300-\u036f]", "")
    return ~bare.rlike(f"^({'|'.join(kernel.KS_NOT)})") & bare.rlike("|".join(kernel.KS_STEMS))


def acronym_words(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in spelling.LETTERS.items() for x in (k, v)])
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(names[F.lower(c)], c)), " ")


# --- numbers (NUM1, NUM3, NUM4) -------------------------------------------------------------------------------


def integer_words(n: Column, feminine: bool = False) -> Column:
    """Spelled integers; beyond 18 digits, digit by digit."""
    n = n.cast("long")
    low = F.array(*[F.lit(spelling.below_thousand(i, feminine)) for i in range(1000)])
    high = F.array(*[F.lit(spelling.below_thousand(i)) for i in range(1000)]) if feminine else low
    whole = F.abs(n)
    group = lambda i: F.pmod(F.floor(whole / F.lit(1000**i).cast("decimal(20,0)")), F.lit(1000)).cast("int") if i else F.pmod(whole, F.lit(1000)).cast("int")
    said = []
    for i in range(5, 1, -1):
        one, many = spelling._SCALE[i]
        g = group(i)
        said.append(F.when(g > 0, F.concat(F.get(high, g), F.when(g == 1, F.lit(" " + one)).otherwise(F.lit(" " + many)))))
    g = group(1)
    said.append(F.when(g == 1, F.lit("mil")).when(g > 1, F.concat(F.get(low, g), F.lit(" mil"))))
    last = group(0)
    head = F.array_join(F.array_compact(F.array(*said)), " ")
    tail = F.get(low, last)
    tied = (last < 100) | (F.pmod(last, F.lit(100)) == 0)
    text = F.when(last == 0, head).when(head == "", tail).when(tied, F.concat_ws(" e ", head, tail)).otherwise(F.concat_ws(" ", head, tail))
    text = F.when(n == 0, F.lit("zero")).when(whole >= F.lit(10**18), digit_words(n.cast("string"))).otherwise(text)
    return F.when((n < 0) & (whole < F.lit(10**18)), F.concat(F.lit("menos "), text)).otherwise(text)


def year_words(year: Column) -> Column:
    """NUM5: a year is read as a masculine integer."""
    return integer_words(year)


def ordinal_words(n: Column, feminine: bool = False) -> Column:
    table = F.array(*[F.lit(spelling.ordinal(i, feminine)) for i in range(1000)])
    return F.when((n > 0) & (n < 1000), F.get(table, n.cast("int"))).otherwise(integer_words(n, feminine))


def digit_words(s: Column) -> Column:
    names = F.create_map(*[F.lit(x) for i in range(10) for x in (str(i), spelling.digits(str(i)))])
    kept = F.split(F.regexp_replace(s, r"[-\s]", ""), "")
    return F.array_join(F.transform(kept, lambda c: F.coalesce(names[c], c)), " ")


def decimal_words(whole: Column, fraction: Column, feminine: bool = False) -> Column:
    kept = F.regexp_replace(fraction, "0+$", "")
    rest = F.regexp_replace(kept, "^0+", "")
    zeros = F.array_repeat(F.lit("zero"), F.length(kept) - F.length(rest))
    said = F.array_join(F.array_compact(F.concat(zeros, F.array(F.when(rest != "", integer_words(rest.try_cast("long"), feminine))))), " ")
    return F.when(kept == "", integer_words(whole, feminine)).otherwise(F.concat(integer_words(whole, feminine), F.lit(" vírgula "), said))


# --- sounds between words (SD1-SD5) ---------------------------------------------------------------------------


def _last(ipa: Column, found: str, put: str) -> Column:
    return F.regexp_replace(ipa, f"{found}\\z", put)


def starts_vowel(initial: Column) -> Column:
    return F.coalesce(F.lower(initial).rlike(f"^[{VOWELS}]"), F.lit(False))


def sandhi_s(ipa: Column, initial: Column) -> Column:
    voiced = F.coalesce(F.lower(initial).rlike(f"^[{VOWELS}{VOICED}]"), F.lit(False))
    return F.when(voiced, _last(ipa, "s", "z")).otherwise(_last(ipa, "z", "s"))


def sandhi_r(ipa: Column, initial: Column) -> Column:
    return F.when(starts_vowel(initial), _last(ipa, "r", "ɾ")).otherwise(_last(ipa, "ɾ", "r"))


def sandhi_glide(ipa: Column, initial: Column) -> Column:
    return F.when(starts_vowel(initial), _last(_last(ipa, "ʊ", "w"), "y", "j")).otherwise(_last(_last(ipa, "w", "ʊ"), "j", "y"))


# Words whose end always glides, or never does.
FORCED, BLOCKED = ("se", "tive", "adicionado", "disso", "onde", "me", "de"), ("que",)


def sandhi(word: Column, ipa: Column, initial: Column, curated: Column, by_sense: Column) -> Column:
    """All of them in order; a reading chosen by sense takes every rule and no special case.

    Each rule turns the last sound only, and no rule turns what another one gives, so one case decides on that sound.
    """
    vowel = starts_vowel(initial)
    voiced = F.coalesce(F.lower(initial).rlike(f"^[{VOWELS}{VOICED}]"), F.lit(False))
    glides = F.when(by_sense, F.lit(True)).when(word.isin(*BLOCKED), F.lit(False)).when(word.isin(*FORCED), F.lit(True)).otherwise(~curated)
    last = F.right(ipa, F.lit(1))
    either = lambda on, yes, no: F.when(on, F.lit(yes)).otherwise(F.lit(no))
    turned = F.when(last.isin("s", "z"), either(voiced, "z", "s")).when(last.isin("r", "ɾ"), either(vowel, "ɾ", "r"))
    turned = turned.when(glides & last.isin("ʊ", "w"), either(vowel, "w", "ʊ")).when(glides & last.isin("y", "j"), either(vowel, "j", "y"))
    turned = F.when(~by_sense & (word == "pode") & ~vowel & last.isin("y", "j"), F.lit("y")).otherwise(turned.otherwise(last))
    turned = F.when(~by_sense & (word == "o") & vowel & (ipa == "ʊ") & ~glides, F.lit("u")).otherwise(turned)
    return F.when(ipa == "", ipa).otherwise(F.concat(F.substring(ipa, F.lit(1), F.length(ipa) - 1), turned))


def base_ipa(ipa: Column) -> Column:
    """The form before any of these (MN1)."""
    return F.when(ipa == "", ipa).otherwise(F.concat(F.substring(ipa, F.lit(1), F.length(ipa) - 1), F.translate(F.right(ipa, F.lit(1)), "zwjɾ", "sʊyr")))


# --- phoneme strings (PP1-PP5, CM1-3, CM7) --------------------------------------------------------------------


def decomposed(c: Column) -> Column:
    """NFD over the letters that texts and phoneme strings of the language hold: each mark is set behind its letters, then these lose it."""
    out = c
    for mark in sorted({two[1] for two in COMPOSED.values()}):
        out = F.regexp_replace(out, f"([{''.join(one for one, two in COMPOSED.items() if two[1] == mark)}])", f"$1{mark}")
    out = F.translate(out, "".join(COMPOSED), "".join(two[0] for two in COMPOSED.values()))
    return F.when(c.rlike(COMPOSED_RANGES), out).otherwise(c)


def plain_ipa(c: Column) -> Column:
    """CM1: comparable form; null as empty."""
    c = F.coalesce(c, F.lit(""))
    for joiner in ("\u200d", "\u200c"):
        c = F.replace(c, F.lit(joiner), F.lit(""))
    c = F.replace(decomposed(c), F.lit("g"), F.lit("ɡ"))
    for mark in ("ˈ", "\u0303"):  # a search for two of them is far quicker than the replacement
        c = F.when(F.contains(c, F.lit(mark * 2)), F.regexp_replace(c, f"{mark}{{2,}}", mark)).otherwise(c)
    return F.trim(c)


def speech_text(ipa: Column) -> Column:
    """PP2: the tokens of ``speech_tokens``, joined."""
    marks = ".,!?:;…"
    c = ipa
    for joiner in "_\u200d\u200c":
        c = F.replace(c, F.lit(joiner), F.lit(""))
    c = F.replace(decomposed(c), F.lit("c"), F.lit("k"))
    c = F.regexp_replace(c, r"\([^)]*(\)|$)", "")
    c = F.replace(c, F.lit("\n"), F.lit("\ue000 "))  # a comma that takes no space before it
    for mark in marks:
        c = F.replace(c, F.lit(mark), F.lit(f" {mark} "))
    c = F.regexp_replace(c, f"^ ([{marks}])", "$1")  # what was the first character takes none before it either
    return F.regexp_replace(F.replace(c, F.lit("\ue000"), F.lit(",")), " {2,}", " ")


def speech_tokens(ipa: Column) -> Column:
    text = speech_text(ipa)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def chunks(ipa: Column, limit: int = 200) -> Column:
    """PP3: pieces of whole clauses, at most ``limit`` characters unless one clause is longer."""
    whole = F.trim(ipa)
    clauses = F.filter(F.transform(F.regexp_extract_all(whole, F.lit("[^.!?…]*[.!?…]|[^.!?…]+"), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def take(acc: Column, p: Column) -> Column:
        longer = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit(" "), p))
        full = (F.length(longer) > limit) & (acc["now"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(longer).alias("now"))

    packed = F.aggregate(clauses, start, take, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= limit, F.array(whole)).otherwise(packed)


def pauses(ipa: Column) -> Column:
    """PP4: array of (ipa, punct); punct is null after the last mark."""
    found = F.regexp_extract_all(ipa, F.lit("[^,;:.!?…]*[,;:.!?…]|[^,;:.!?…]+"), F.lit(0))

    def cut(p: Column) -> Column:
        marked = p.rlike("[,;:.!?…]$")
        text = F.when(marked, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        return F.struct(F.trim(text).alias("ipa"), F.when(marked, F.right(p, F.lit(1))).alias("punct"))

    return F.filter(F.transform(found, cut), lambda x: x["ipa"] != "")


def fragments(ipa: Column, limit: int = 200) -> Column:
    """PP5."""
    return F.transform(chunks(ipa, limit), lambda c: F.struct(pauses(c).alias("fragments")))


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bare(word: Column) -> Column:
    """In lower case, without the hyphens and quotes around it."""
    return F.btrim(F.lower(word), F.lit("'-"))


def ipa_words(ipa: Column) -> Column:
    """The runs without white space, without the marks around them. Patterns of such marks are slow where threads share them, so none is used."""
    spaced = ipa
    for c in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    parts = F.split(F.when(ipa.rlike("[\\t\\n\\x0B\\f\\r]"), spaced).otherwise(ipa), " ")
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit(";:,.!?¡¿—…\"«»“”(){}"))), lambda w: w != "")


def divergence(a: Column, b: Column) -> Column:
    """CM7: in what two readings of a word differ."""
    without = lambda c, marks: without(F.replace(c, F.lit(marks[0]), F.lit("")), marks[1:]) if marks else c
    apart = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    more = F.abs(F.length(a) - F.length(b))
    unmarked = without(a, "ˈˌ") == without(b, "ˈˌ")
    many = F.get(F.array(*[F.lit(f"{i}-char-diff") for i in range(4)], F.lit("varios-chars-diff")), F.least(apart, F.lit(4)))
    return (
        F.when(without(a, "ˌ") == without(b, "ˌ"), F.lit("acento-secundario"))
        .when(without(a, "ˈ") == without(b, "ˈ"), F.lit("acento-primario"))
        .when(unmarked, F.lit("posicao-acento"))
        .when(more == 0, many)
        .when(more <= 3, F.concat(more.cast("string"), F.lit("-char-len")))
        .otherwise(F.lit("estrutural"))
    )
