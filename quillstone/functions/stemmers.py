"""The published Snowball algorithms for English (Porter2) and Spanish."""

from __future__ import annotations

import re

# Fixed values of the published algorithms: exceptional forms and suffixes.
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble",
}
_EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_ES_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
_ES_STANDARD = {
    "delete": ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"),
    "ic": ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"),
    "log": ("logía", "logías"), "u": ("ución", "uciones"), "ente": ("encia", "encias"), "amente": ("amente",), "mente": ("mente",), "idad": ("idad", "idades"), "iva": ("iva", "ivo", "ivas", "ivos"),
}
_ES_Y = ("yamos", "yendo", "yeron", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó")
_ES_VERB_EM = ("emos", "en", "es", "éis")
_ES_VERB = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré", "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré", "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an",
    "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses",
    "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)

_VOWELS_EN, _VOWELS_ES = "aeiouy", "aeiouáéíóúü"


def _after(word: str, vowels: str, start: int = 0) -> int:
    """The region after the first consonant that follows a vowel."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def english(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = w.removeprefix("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub("([aeiouy])y", r"\1Y", w)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _after(w, _VOWELS_EN)
    r2 = _after(w, _VOWELS_EN, r1)

    def short(x: str) -> bool:
        return bool(re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", x))

    w = w[: len(w) - len(_longest(w, ("'s'", "'s", "'")))]
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT:
        return w.lower()
    s = _longest(w, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: len(w) - len(s)] + "ee"
    elif s and re.search("[aeiouy]", w[: len(w) - len(s)]):
        w = w[: len(w) - len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _longest(w, [*_EN_STEP2, "ogi", "li"])
    if s and len(w) - len(s) >= r1:
        if s in _EN_STEP2:
            w = w[: len(w) - len(s)] + _EN_STEP2[s]
        elif s == "ogi" and w.endswith("logi"):
            w = w[:-1]
        elif s == "li" and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    s = _longest(w, [*_EN_STEP3, "ative"])
    if s and len(w) - len(s) >= r1:
        if s in _EN_STEP3:
            w = w[: len(w) - len(s)] + _EN_STEP3[s]
        elif len(w) - len(s) >= r2:
            w = w[: len(w) - len(s)]
    s = _longest(w, [*_EN_STEP4, "ion"])
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _es_rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in _VOWELS_ES:
        at = re.compile(f"[{_VOWELS_ES}]").search(w, 2)
        return at.end() if at else len(w)
    if w[0] in _VOWELS_ES:
        at = re.compile(f"[^{_VOWELS_ES}]").search(w, 2)
        return at.end() if at else len(w)
    return 3


_PLAIN = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    w = word.lower()
    r1 = _after(w, _VOWELS_ES)
    r2, rv = _after(w, _VOWELS_ES, r1), _es_rv(w)
    s = _longest(w, _ES_PRONOUNS)
    if s and len(w) - len(s) >= rv:
        base = w[: len(w) - len(s)]
        ending = _longest(base, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if ending and len(base) - len(ending) >= rv and (ending != "yendo" or base.endswith("uyendo")):
            w = base[: len(base) - len(ending)] + ending.translate(_PLAIN)
    before = w
    kind, s = max(((k, x) for k, xs in _ES_STANDARD.items() for x in xs if w.endswith(x)), key=lambda p: len(p[1]), default=("", ""))
    at = len(w) - len(s)
    if s and kind == "amente":
        if at >= r1:
            w = w[:at]
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                w = w[:-2]
    elif s and at >= r2:
        w = w[:at]
        then = {"ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iva": ("at",)}.get(kind, ())
        if kind in ("log", "u", "ente"):
            w += kind
        elif (x := _longest(w, then)) and len(w) - len(x) >= r2:
            w = w[: len(w) - len(x)]
    if w == before:
        s = _longest(w, [x for x in _ES_Y if len(w) - len(x) >= rv])
        if s and w[: len(w) - len(s)].endswith("u"):
            w = w[: len(w) - len(s)]
        else:
            s = _longest(w, [x for x in (*_ES_VERB, *_ES_VERB_EM) if len(w) - len(x) >= rv])
            if s:
                w = w[: len(w) - len(s)]
                if s in _ES_VERB_EM and w.endswith("gu"):
                    w = w[:-1]
    s = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and len(w) - len(s) >= rv:
        w = w[: len(w) - len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS = {"english": english, "spanish": spanish}
