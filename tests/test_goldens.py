"""Published input and output pairs of the text functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from fonotrama.functions import columns as X
from fonotrama.functions import kernel, normalise, spelling

INTEGERS = {
    0: "zero", 9: "nove", 15: "quinze", 21: "vinte e um", 99: "noventa e nove", 100: "cem", 101: "cento e um", 200: "duzentos", 999: "novecentos e noventa e nove", 1000: "mil",
    1200: "mil e duzentos", 1234: "mil duzentos e trinta e quatro", 1998: "mil novecentos e noventa e oito", 2025: "dois mil e vinte e cinco", 1000000: "um milhão", 2000000: "dois milhões",
    1234567: "um milhão duzentos e trinta e quatro mil quinhentos e sessenta e sete", -5: "menos cinco", 1200000: "um milhão duzentos mil", 10**15: "um quatrilhão",
}
FEMININE = {1: "uma", 2: "duas", 22: "vinte e duas", 200: "duzentas"}
ORDINALS = {1: "primeiro", 2: "segundo", 10: "décimo", 21: "vigésimo primeiro", 42: "quadragésimo segundo", 500: "quinquagésimo"}
NORMALISED = {
    "olá “mundo”": 'olá "mundo"', "ele ‘disse’": "ele 'disse'", "a–b": "a—b", "fim…": "fim...", "a & b": "a e b", "x = 5": "x igual a cinco", "42": "quarenta e dois", "100": "cem",
    "2025": "dois mil e vinte e cinco", "3,14": "três vírgula quatorze", "1.234": "mil duzentos e trinta e quatro", "07/09/2025": "sete de setembro de dois mil e vinte e cinco",
    "14:30": "quatorze horas e trinta minutos", "9h15": "nove horas e quinze minutos", "9h": "nove horas", "R$ 10": "dez reais", "R$ 1": "um real", "50%": "cinquenta por cento",
    "30°C": "trinta graus celsius", "1º": "primeiro", "2º": "segundo", "1ª": "primeira", "2ª": "segunda", "Sr. Silva": "senhor Silva", "Dra. Ana": "doutora Ana", "Dr. João": "doutor João", "ONU": "onu",
    "R$ 10,5": "dez reais e cinquenta centavos", "US$ 3": "três dólares", "ana@casa.com": "ana arroba casa ponto com", "https://www.casa.com/x?y=1": "casa ponto com", "01/02/2020": "primeiro de fevereiro de dois mil e vinte",
    "3.14": "três . quatorze", "(11) 91234-5678": "um um nove um dois três quatro cinco seis sete oito",
}
SPLIT = {
    "Olá mundo. Como vai?": ["Olá mundo.", "Como vai?"], "Primeiro; segundo. Terceiro!": ["Primeiro; segundo.", "Terceiro!"], "O Sr. Silva chegou. Bem-vindo!": ["O Sr. Silva chegou.", "Bem-vindo!"],
    "O valor é 3.14 reais. Entendeu?": ["O valor é 3.14 reais.", "Entendeu?"], "Primeiro parágrafo.\n\nSegundo parágrafo.": ["Primeiro parágrafo.", "Segundo parágrafo."], "Ele pensou... E foi.": ["Ele pensou...", "E foi."],
    "": [], "   \n\n  ": [], "Uma frase sem ponto final": ["Uma frase sem ponto final"], "A. Silva chegou.": ["A. Silva chegou."], "Ele disse: Oi! e saiu.": ["Ele disse: Oi! e saiu."],
    "Primeira. Segunda! Terceira?": ["Primeira.", "Segunda!", "Terceira?"], 'Ele disse "Olá." E saiu.': ['Ele disse "Olá."', "E saiu."], "Vitamina C. Depois": ["Vitamina C. Depois"],
}
CONTAINS = {
    "ks": "táxi taxista fixo prefixo sexo tóxico nexo anexo hidroxila oxigênio flexão", "ʃ": "abacaxi mexer lixo caixa peixe", "ez": "exame exemplo exato", "ɐ̃ʊ̃": "falam cantam fizeram pão coração",
    "ɐ̃ɪ̃": "mãe pães", "õɪ̃": "põe", "eɪ": "tempo vem homem", "ũ": "testemunhando inhaúma pergunta", "kw": "quatro quando cinquenta tranquilo", "aʊ": "pau causa saudade alto palma caldo", "eʊ": "meu deus",
    "ɛʊ": "céu", "ow": "cantou outro", "idʒjʊ": "radionuclídeo", "ŋx": "enrola", "tʃj": "existe", "ʒj": "hoje", "ʃw": "abaixo", "zw": "criterioso",
}
LACKS = {"ks": "taxa taxação sexta sextante anexim", "ez": "extensão", "eɪ": "tenho", "ĩ": "vinho ninho", "õ": "ponto sonho", "ũ": "resumia", "kw": "quero quente"}


def test_numbers():
    assert {n: spelling.integer(n) for n in INTEGERS} == INTEGERS
    assert {n: spelling.integer(n, True) for n in FEMININE} == FEMININE
    assert {n: spelling.ordinal(n) for n in ORDINALS} == ORDINALS
    assert spelling.ordinal(500, strict_compat=False) == "quingentésimo"
    assert [spelling.ordinal(n, True) for n in (1, 42)] == ["primeira", "quadragésima segunda"]
    assert [spelling.decimal(*x) for x in ((3, "14"), (0, "05"), (1, "5"), (10, "00"))] == ["três vírgula quatorze", "zero vírgula zero cinco", "um vírgula cinco", "dez"]
    assert [spelling.digits(x) for x in ("123", "9-8", "(11) 9")] == ["um dois três", "nove oito", "( um um ) nove"]


def test_native_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in INTEGERS], "n long")
    assert {r.n: r.w for r in rows.select("n", X.integer_words(F.col("n")).alias("w")).collect()} == INTEGERS
    rows = spark.createDataFrame([(n,) for n in (*FEMININE, 1002, 2000, 222222)], "n long")
    assert all(r.w == spelling.integer(r.n, True) for r in rows.select("n", X.integer_words(F.col("n"), True).alias("w")).collect())
    rows = spark.createDataFrame([(n,) for n in (0, *ORDINALS, 999, 1000)], "n long")
    assert all(r.w == spelling.ordinal(r.n) for r in rows.select("n", X.ordinal_words(F.col("n")).alias("w")).collect())
    rows = spark.createDataFrame([(3, "14"), (0, "05"), (1, "5"), (10, "00"), (7, "007")], "n long, f string")
    assert all(r.w == spelling.decimal(r.n, r.f) for r in rows.select("n", "f", X.decimal_words(F.col("n"), F.col("f")).alias("w")).collect())


@pytest.mark.parametrize("text", NORMALISED)
def test_normalise(text):
    assert normalise.normalise(text) == NORMALISED[text]


def test_normalise_options():
    assert normalise.normalise("42", numbers=False) == "42"
    assert "xis, ípsilon, zê".replace(",", "") in normalise.normalise("XYZ").replace(",", "")
    assert [normalise.needs_normalising(w) for w in ("casa", "banana", "exemplo", "Brasil")] == [False] * 4
    assert all(map(normalise.needs_normalising, ("dr", "etc", "kg", "Dr", "casa.", "100", "3,14", "50%", "a&b", "ldl")))
    assert all(map(normalise.vowelless, ("ldl", "NGF", "vldl", "lh", "pst", "shhh", "xyz", "www"))) and not any(map(normalise.vowelless, ("bem", "n1", "a", "cá", "abcdefg")))


@pytest.mark.parametrize("text", SPLIT)
def test_sentences(text):
    assert normalise.sentences(text) == SPLIT[text]


@pytest.mark.parametrize("part", CONTAINS)
def test_sounds(part):
    want = unicodedata.normalize("NFD", part)
    assert [w for w in CONTAINS[part].split() if want not in kernel.word_ipa(w)] == []


@pytest.mark.parametrize("part", LACKS)
def test_sounds_absent(part):
    want = unicodedata.normalize("NFD", part)
    assert [w for w in LACKS[part].split() if want in kernel.word_ipa(w)] == []


def test_traces():
    assert kernel.word_ipa("casa") == "kˈazæ" and kernel.word_ipa("cinquenta") == "sˌiŋkwˈeɪŋtæ"
    assert len(kernel.syllables("casa")) == 2 and kernel.sounded_u("cinquenta") and kernel.sounded_u("tranquilo")
    assert not any(map(kernel.sounded_u, ("quente", "guerra", "quatro")))


def test_phoneme_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.speech_tokens(F.lit("kˈazæ"))) == ["k", "ˈ", "a", "z", "æ"]
    assert "c" not in one(X.speech_tokens(F.lit("casa"))) and "(" not in one(X.speech_text(F.lit("(en)hello")))
    assert one(X.speech_tokens(F.lit("a\nb"))) == ["a", ",", " ", "b"] and one(X.speech_tokens(F.lit("kˈazæ."))) == [*"kˈazæ", " ", ".", " "]
    assert one(X.speech_text(F.lit(".a b"))) == ". a b" and one(X.speech_text(F.lit(" .a"))) == " . a" and one(X.speech_text(F.lit("a?!b"))) == "a ? ! b"
    long = "a" * 150 + ". " + "b" * 60 + ". " + "c" * 300 + "? d."
    assert one(X.chunks(F.lit(long))) == ["a" * 150 + ".", "b" * 60 + ".", "c" * 300 + "?", "d."]
    assert one(X.chunks(F.lit(" x. "))) == ["x."] and one(X.chunks(F.lit(""))) == []
    assert [tuple(p) for p in one(X.pauses(F.lit("a, b.. c")))] == [("a", ","), ("b", "."), ("c", None)]
    assert one(X.base_ipa(X.base_ipa(F.lit("kazaz")))) == one(X.base_ipa(F.lit("kazaz"))) == "kazas"
