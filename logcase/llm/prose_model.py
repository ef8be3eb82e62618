"""A fixed model of what prose, slugs, paths, identifiers and numbers look like, character by character.

A Markov chain over ``SYMBOLS``: shares of the kinds of character (small letter, capital, digit, mark) that follow each
other, times the letter pairs of ``WORDS``, without regard to case. It is learned from nothing in the table scanned, so
that it can hold no secret and judges a text alike whatever surrounds it.
"""
from __future__ import annotations

import math
from collections import Counter

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Frequent words and word parts of English, German, French, Spanish, Italian, Portuguese, Dutch, Polish and Finnish, and of code.
WORDS = """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she
there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two
may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down
should because each just those people how too little state good very make world still own see men work long get here between both life being under never
day same another know while last might us great old year off come since against go came right used take three states himself few house use during without
again place around however home small found thought went say part once general high upon school every government company system number information
development administration understanding communication environmental representative characteristics straightforward
die der und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch
wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom schon wenn habe seine ihre dann unter wir
soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer millionen was sagte gesellschaft geschwindigkeit
entwicklung wissenschaft zusammenarbeit bundesregierung krankenversicherung freundschaft heiterkeit schwierigkeiten rechtsschutz
le la les de des du et un une est que qui dans pour pas sur au avec ce il sont plus par ne se son sa ses mais comme ou si leur nous vous tout elle
faire deux aussi bien peut cette sans entre autres encore temps toujours jamais beaucoup monde pays gouvernement developpement malheureusement
quelque chose aujourd travailleurs nouveaux chevaux eaux elles mentaux
el los las y en un una por con para no es al lo como mas pero sus le ha me sin sobre este ya entre cuando todo esta ser son dos fue era muy hasta desde
donde quien durante siempre todos uno ni contra otros ese eso ante ellos desarrollo conocimiento universidades
il di che e la in un per non sono una del si con da come anche dei nel alla della piu questo stato suo essere perche molto quando ancora trasformazione
o que de um para com uma os no se na por mais as dos como mas ao ele das seu sua ou quando muito nos ja eu tambem pelo pela ate isso voce desenvolvimento
het een van en te dat op zijn voor met niet aan er om ook als dan maar bij nog uit naar heeft wordt werd door ontwikkeling
nie na sie jest do ze to jak przez po co tak dla od za ale ktory tylko przy prawdopodobniej rozwoj wszystkie
ja on ei se oli han mutta kuin myos joka ovat niin sen tai vain kun mita kaikki lentokone suihku turbiini moottori kehitys
index content article category product page image html http www com org net data value key name file path class element get set list item type string
config option request response server client user error message default application document version update create delete select width height color
button module package import export function return object array table query test example download upload static assets style script""".split()

_KINDS = ("^", "U", "l", "d", "m")
#: Shares of the kinds (capital, small, digit, mark) that follow the start of a token and each kind.
_NEXT = {"^": (.28, .60, .08, .04), "U": (.40, .55, .01, .04), "l": (.015, .93, .010, .045), "d": (.03, .05, .55, .37), "m": (.20, .55, .15, .10)}
#: Each letter's pairs in WORDS count together with so many draws from the letters alone, as other languages have the same
#: frequent letters in other pairs.
_SMOOTH = 25.0


def _kind(c: str) -> str:
    return "U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "m"


def costs(separated: bool = False) -> list[float]:
    """-ln P(b | a) at place(a) * 65 + place(b), places being those in ``SYMBOLS`` from 1; 0 is the start as ``a`` and any
    other character as ``b`` (a mark). ``separated``: given that ``b`` is no separator, all marks counted as such."""
    single, first, pairs = Counter(), Counter(), Counter()
    for w in WORDS:
        single.update(w)
        first[w[0]] += 1
        pairs.update(zip(w, w[1:]))
    letters = "abcdefghijklmnopqrstuvwxyz"
    alone = {c: (single[c] + 2) / (sum(single.values()) + 52) for c in letters}
    after = Counter()
    for (a, _), k in pairs.items():
        after[a] += k

    def share(a: str, b: str) -> float:
        kind, before = _kind(b), _kind(a) if a else "^"
        p = _NEXT[before][_KINDS.index(kind) - 1]
        if kind == "d":
            return p / 10
        if kind == "m":
            return p / 3
        b = b.lower()
        if before in "Ul":
            a = a.lower()
            return p * (pairs[a, b] + _SMOOTH * alone[b]) / (after[a] + _SMOOTH)
        return p * (first[b] + _SMOOTH * alone[b]) / (sum(first.values()) + _SMOOTH)

    marked = ["=", *SYMBOLS]
    given = lambda a: math.log(1 - _NEXT[_kind(a) if a else "^"][3]) if separated else 0.0
    return [given(a) - math.log(share(a, b)) for a in ("", *SYMBOLS) for b in marked]
