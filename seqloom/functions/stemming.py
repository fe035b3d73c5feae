"""Snowball stemmers from the published algorithms: English (Porter2), German, French."""

from __future__ import annotations

import re

# ---------------------------------------------------------------- regions


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Just past the first non-vowel that follows a vowel, from ``start``."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _ends(word: str, suffixes: list[str]) -> str:
    """The longest of ``suffixes`` that the word ends with."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


# ---------------------------------------------------------------- English

# The exceptions and suffix rewrites of the published algorithm.
EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
EN_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
_EN_VOWELS = "aeiouy"


def _short_end(word: str) -> bool:
    return bool(re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def english(word: str) -> str:
    word = word.lower().replace("’", "'")
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in EN_WHOLE:
        return EN_WHOLE[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    head = re.match(r"gener|commun|arsen", word)
    r1 = head.end() if head else _after(word, _EN_VOWELS)
    r2 = _after(word, _EN_VOWELS, r1)
    word = re.sub(r"('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", word):
        word = word[:-1]
    if word in EN_AFTER_1A:
        return word
    # 1b
    if s := _ends(word, ["eed", "eedly"]):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif (s := _ends(word, ["ed", "edly", "ing", "ingly"])) and re.search(r"[aeiouy]", word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _short_end(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_VOWELS:
        word = word[:-1] + "i"
    # 2
    if s := _ends(word, [*EN_STEP2, "ogi", "li"]):
        if len(word) - len(s) >= r1:
            if s == "ogi":
                word = word[:-1] if word.endswith("logi") else word
            elif s == "li":
                word = word[:-2] if word[:-2].endswith(tuple("cdeghkmnrt")) else word
            else:
                word = word[: -len(s)] + EN_STEP2[s]
    # 3
    if s := _ends(word, [*EN_STEP3, "ative"]):
        if len(word) - len(s) >= r1:
            if s == "ative":
                word = word[:-5] if len(word) - 5 >= r2 else word
            else:
                word = word[: -len(s)] + EN_STEP3[s]
    # 4
    if s := _ends(word, [*EN_STEP4, "ion"]):
        if len(word) - len(s) >= r2 and (s != "ion" or word[-4:-3] in ("s", "t")):
            word = word[: -len(s)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# ---------------------------------------------------------------- German

_DE_VOWELS = "aeiouyäöü"


def german(word: str) -> str:
    word = word.lower().replace("ß", "ss")
    word = re.sub(rf"(?<=[{_DE_VOWELS}])u(?=[{_DE_VOWELS}])", "U", word)
    word = re.sub(rf"(?<=[{_DE_VOWELS}])y(?=[{_DE_VOWELS}])", "Y", word)
    r1 = _after(word, _DE_VOWELS)
    r2 = _after(word, _DE_VOWELS, r1)
    r1 = max(r1, 3)
    # 1
    s = _ends(word, ["em", "ern", "er", "e", "en", "es", "s"])
    if s and len(word) - len(s) >= r1:
        if s == "s":
            word = word[:-1] if word[-2:-1] in tuple("bdfghklmnrt") else word
        else:
            word = word[: -len(s)]
            if s in ("e", "en", "es") and word.endswith("niss"):
                word = word[:-1]
    # 2
    s = _ends(word, ["en", "er", "est", "st"])
    if s and len(word) - len(s) >= r1 and (s != "st" or (len(word) >= 6 and word[-3] in "bdfghklmnt")):
        word = word[: -len(s)]
    # 3
    s = _ends(word, ["end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"])
    if s and len(word) - len(s) >= r2:
        stem = word[: -len(s)]
        if s in ("end", "ung"):
            word = stem
            if word.endswith("ig") and len(word) - 2 >= r2 and not word.endswith("eig"):
                word = word[:-2]
        elif s in ("ig", "ik", "isch"):
            word = stem if not stem.endswith("e") else word
        elif s in ("lich", "heit"):
            word = stem
            for t in ("er", "en"):
                if word.endswith(t) and len(word) - 2 >= r1:
                    word = word[:-2]
                    break
        else:
            word = stem
            for t in ("lich", "ig"):
                if word.endswith(t) and len(word) - len(t) >= r2:
                    word = word[: -len(t)]
                    break
    return word.translate(str.maketrans("äöüUY", "aouuy"))


# ---------------------------------------------------------------- French

_FR_VOWELS = "aeiouyâàëéêèïîôûù"
# The verb endings of the published algorithm.
FR_I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
FR_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    word = word.lower()
    word = re.sub(rf"(?<=[{_FR_VOWELS}])([ui])(?=[{_FR_VOWELS}])", lambda m: m[1].upper(), word)
    word = re.sub(rf"(?<=[{_FR_VOWELS}])y|y(?=[{_FR_VOWELS}])", "Y", word)
    word = re.sub(r"(?<=q)u", "U", word)
    if re.match(rf"[{_FR_VOWELS}]{{2}}|par|col|tap", word):
        rv = 3
    else:
        m = re.compile(f"[{_FR_VOWELS}]").search(word, 1)
        rv = m.end() if m else len(word)
    r1 = _after(word, _FR_VOWELS)
    r2 = _after(word, _FR_VOWELS, r1)
    fits = lambda s, r: len(word) - len(s) >= r
    start, again = word, True
    # 1: noun and adjective endings
    s = _ends(word, "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses amment emment ment ments issement issements".split())
    if s in "ance iqUe isme able iste eux ances iqUes ismes ables istes".split() and fits(s, r2):
        word, again = word[: -len(s)], False
    elif s in "atrice ateur ation atrices ateurs ations".split() and fits(s, r2):
        word, again = word[: -len(s)], False
        if word.endswith("ic"):
            word = word[:-2] if len(word) - 2 >= r2 else word[:-2] + "iqU"
    elif s in ("logie", "logies") and fits(s, r2):
        word, again = word[: -len(s)] + "log", False
    elif s in ("usion", "ution", "usions", "utions") and fits(s, r2):
        word, again = word[: -len(s)] + "u", False
    elif s in ("ence", "ences") and fits(s, r2):
        word, again = word[: -len(s)] + "ent", False
    elif s in ("ement", "ements") and fits(s, rv):
        word, again = word[: -len(s)], False
        if word.endswith("iv") and len(word) - 2 >= r2:
            word = word[:-2]
            word = word[:-2] if word.endswith("at") and len(word) - 2 >= r2 else word
        elif word.endswith("eus"):
            word = word[:-3] if len(word) - 3 >= r2 else word[:-1] + "x" if len(word) - 3 >= r1 else word
        elif word.endswith(("abl", "iqU")) and len(word) - 3 >= r2:
            word = word[:-3]
        elif word.endswith(("ièr", "Ièr")) and len(word) - 3 >= rv:
            word = word[:-3] + "i"
    elif s in ("ité", "ités") and fits(s, r2):
        word, again = word[: -len(s)], False
        if word.endswith("abil"):
            word = word[:-4] if len(word) - 4 >= r2 else word[:-2] + "l"
        elif word.endswith("ic"):
            word = word[:-2] if len(word) - 2 >= r2 else word[:-2] + "iqU"
        elif word.endswith("iv") and len(word) - 2 >= r2:
            word = word[:-2]
    elif s in ("if", "ive", "ifs", "ives") and fits(s, r2):
        word, again = word[: -len(s)], False
        if word.endswith("at") and len(word) - 2 >= r2:
            word = word[:-2]
            if word.endswith("ic"):
                word = word[:-2] if len(word) - 2 >= r2 else word[:-2] + "iqU"
    elif s == "eaux":
        word, again = word[:-1], False
    elif s == "aux" and fits(s, r1):
        word, again = word[:-2] + "l", False
    elif s in ("euse", "euses") and (fits(s, r2) or fits(s, r1)):
        word, again = word[: -len(s)] + ("" if fits(s, r2) else "eux"), False
    elif s in ("issement", "issements") and fits(s, r1) and word[: -len(s)] and word[: -len(s)][-1] not in _FR_VOWELS:
        word, again = word[: -len(s)], False
    elif s == "amment" and fits(s, rv):
        word = word[:-6] + "ant"
    elif s == "emment" and fits(s, rv):
        word = word[:-6] + "ent"
    elif s in ("ment", "ments") and len(word) - len(s) - 1 >= rv and word[-len(s) - 1] in _FR_VOWELS:
        word = word[: -len(s)]
    # 2: verb endings
    if again:
        before = word
        s = _ends(word[rv:], FR_I_VERBS)
        if s and len(word) - len(s) - 1 >= rv and word[-len(s) - 1] not in _FR_VOWELS:
            word = word[: -len(s)]
        elif (s := _ends(word[rv:], ["ions", *FR_VERBS, *FR_A_VERBS])) :
            if s == "ions":
                word = word[:-4] if fits(s, r2) else word
            else:
                word = word[: -len(s)]
                if s in FR_A_VERBS and word.endswith("e") and len(word) - 1 >= rv:
                    word = word[:-1]
        again = word == before
    if word != start:
        # 3
        word = word[:-1] + "i" if word.endswith("Y") else word[:-1] + "c" if word.endswith("ç") else word
    else:
        # 4: what is left
        if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
            word = word[:-1]
        s = _ends(word[rv:], ["ion", "ier", "ière", "Ier", "Ière", "e", "ë"])
        if s == "ion" and fits(s, r2) and len(word) - 4 >= rv and word[-4] in "st":
            word = word[:-3]
        elif s in ("ier", "ière", "Ier", "Ière"):
            word = word[: -len(s)] + "i"
        elif s == "e" or (s == "ë" and word.endswith("guë")):
            word = word[:-1]
    # 5 and 6
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    word = re.sub(rf"[éè](?=[^{_FR_VOWELS}]+$)", "e", word)
    return word.lower()


STEMMERS = {"en": english, "de": german, "fr": french}
