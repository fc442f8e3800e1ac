"""Numbers, letters and clock words spelled out in Portuguese. Plain Python, no Spark."""

from __future__ import annotations

# The names of numbers and letters. The 500th stands as it does in the tables that results are
# held against; ``strict_compat=False`` mends it.
_ONES = ["zero", "um", "dois", "três", "quatro", "cinco", "seis", "sete", "oito", "nove"]
_TEENS = ["dez", "onze", "doze", "treze", "quatorze", "quinze", "dezesseis", "dezessete", "dezoito", "dezenove"]
_TENS = {2: "vinte", 3: "trinta", 4: "quarenta", 5: "cinquenta", 6: "sessenta", 7: "setenta", 8: "oitenta", 9: "noventa"}
_HUNDREDS = {1: "cento", 2: "duzentos", 3: "trezentos", 4: "quatrocentos", 5: "quinhentos", 6: "seiscentos", 7: "setecentos", 8: "oitocentos", 9: "novecentos"}
_SCALE = {2: ("milhão", "milhões"), 3: ("bilhão", "bilhões"), 4: ("trilhão", "trilhões"), 5: ("quatrilhão", "quatrilhões")}
_NTH = (
    {1: "primeiro", 2: "segundo", 3: "terceiro", 4: "quarto", 5: "quinto", 6: "sexto", 7: "sétimo", 8: "oitavo", 9: "nono"},
    {1: "décimo", 2: "vigésimo", 3: "trigésimo", 4: "quadragésimo", 5: "quinquagésimo", 6: "sexagésimo", 7: "septuagésimo", 8: "octogésimo", 9: "nonagésimo"},
    {1: "centésimo", 2: "ducentésimo", 3: "trecentésimo", 4: "quadringentésimo", 5: "quinquagésimo", 6: "seiscentésimo", 7: "septingentésimo", 8: "octingentésimo", 9: "noningentésimo"},
)
LETTERS = {
    "a": "á", "b": "bê", "c": "cê", "d": "dê", "e": "é", "f": "éfe", "g": "gê", "h": "agá", "i": "i", "j": "jota", "k": "cá", "l": "éle", "m": "ême",
    "n": "êne", "o": "ó", "p": "pê", "q": "quê", "r": "érre", "s": "ésse", "t": "tê", "u": "u", "v": "vê", "w": "dábliu", "x": "xis", "y": "ípsilon", "z": "zê",
}


def below_thousand(n: int, feminine: bool = False) -> str:
    """0 gives an empty string."""
    if n == 100:
        return "cem"
    hundred, rest = divmod(n, 100)
    said = []
    if hundred:
        word = _HUNDREDS[hundred]
        said.append(word[:-2] + "as" if feminine and hundred > 1 else word)
    one = lambda k: {1: "uma", 2: "duas"}.get(k, _ONES[k]) if feminine else _ONES[k]
    if 0 < rest < 10:
        said.append(one(rest))
    elif 10 <= rest < 20:
        said.append(_TEENS[rest - 10])
    elif rest:
        said.append(_TENS[rest // 10])
        if rest % 10:
            said.append(one(rest % 10))
    return " e ".join(said)


def integer(n: int, feminine: bool = False) -> str:
    if n < 0:
        return "menos " + integer(-n, feminine) if abs(n) < 10**18 else digits(str(n))
    if n == 0:
        return _ONES[0]
    if n >= 10**18:
        return digits(str(n))
    groups, rest = [], n
    while rest:
        rest, last = divmod(rest, 1000)
        groups.append(last)
    said = []
    for i in range(len(groups) - 1, -1, -1):
        g = groups[i]
        if not g:
            continue
        if i == 0:
            said.append(below_thousand(g, feminine))
        elif i == 1:
            said.append("mil" if g == 1 else below_thousand(g, feminine) + " mil")
        else:
            said.append(f"{below_thousand(g)} {_SCALE[i][g > 1]}")
    if len(said) == 1:
        return said[0]
    last = groups[0]
    tied = last > 0 and (last < 100 or last % 100 == 0)
    return " ".join(said[:-1]) + (" e " if tied else " ") + said[-1]


def parsed(s: str) -> int:
    """As a signed 64-bit integer; 0 if it isn't one."""
    return int(s) if s.isascii() and s.isdigit() and int(s) < 2**63 else 0


def decimal(whole: int, fraction: str, feminine: bool = False) -> str:
    kept = fraction.rstrip("0")
    if not kept:
        return integer(whole, feminine)
    rest = kept.lstrip("0")
    said = [_ONES[0]] * (len(kept) - len(rest))
    if rest.isascii() and rest.isdigit() and int(rest) < 2**63:
        said.append(integer(int(rest), feminine))
    return f"{integer(whole, feminine)} vírgula {' '.join(said)}"


def ordinal(n: int, feminine: bool = False, strict_compat: bool = True) -> str:
    if not 0 < n < 1000:
        return integer(n, feminine)
    said = [_NTH[2 - k][d] for k, d in enumerate(divmod(n, 100)[:1] + divmod(n % 100, 10)) if d]
    if not strict_compat and n // 100 == 5:
        said[0] = "quingentésimo"
    return " ".join(w[:-1] + "a" if feminine and w.endswith("o") else w for w in said)


def digits(s: str) -> str:
    return " ".join(_ONES[int(c)] if c in "0123456789" else c for c in s if c != "-" and not c.isspace())


def acronym(s: str) -> str:
    return " ".join(LETTERS.get(c.lower() if c.isascii() else c, c) for c in s)
