"""Personal data: identifiers in the text as it stands, and in a deobfuscated form whose spans map back to the source."""

from __future__ import annotations

import re
import unicodedata
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.credentials import Covered, _scanner

#: The contract's base patterns. A digit run that fails from its start fails from any later digit too, hence the look-behind.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KINDS = ("email", "ip", "card", "phone", "hidden_email", "hidden_ip", "hidden_card", "hidden_phone")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping per kind."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        # leftmost start of a match: back over the local part, but not into the match before
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


#: Letters of other scripts that look like Latin ones. Full-width forms and other scripts' digits follow from the character database.
LOOKALIKES = dict(zip("аеорсхуіѕјԁһԛԝАВЕЅІЈКМНОРСТХоνονιρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。", "aeopcxyisjdhqwABESIJKMHOPCTXovovipABEZHIKMNOPTYX..", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DISGUISED = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～]|(?![0-9])\\d")
NUMBERS = "zero one two three four five six seven eight nine".split()
NUMBER = "|".join(NUMBERS)
GAP = r"[\x20,.-]{1,3}"
SPELLED = re.compile(rf"\b(?:plus{GAP})?(?:{NUMBER}|[0-9])(?:{GAP}(?:{NUMBER}|[0-9]))*\b", re.IGNORECASE | re.ASCII)
NUMBER_WORD = re.compile(rf"\b(?:{NUMBER})\b", re.IGNORECASE | re.ASCII)
#: The spaces before it belong to it as well, but a search that began with them would take the square of their number.
BRACKETED = re.compile(r"[\[({<]\x20*(at|@|dot|\.)\x20*[\])}>]\x20*", re.IGNORECASE | re.ASCII)
#: A bare "at" counts only before a domain with a spoken dot: "look at example.com" is prose.
SPOKEN = re.compile(r"(?<=[A-Za-z0-9_+%-])\x20+at\x20+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,4}\x20+dot\x20+[A-Za-z]{2})", re.IGNORECASE | re.ASCII)
DOTTED = re.compile(r"(?<=[A-Za-z0-9-])\x20+dot\x20+(?=[A-Za-z0-9])", re.IGNORECASE | re.ASCII)


class Tape:
    """A text under rewriting; every character knows the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, array("q", range(len(text))), array("q", range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, say, spaces: bool = False) -> None:
        """Replace each match by say(match), or leave it when that is None; new characters stand for the whole match, with ``spaces`` also for
        the spaces before it."""
        text, begin, end, done = [], array("q"), array("q"), 0
        for m in pattern.finditer(self.text):
            new = say(m)
            if new is None or m.end() == m.start():
                continue
            a, b = m.span()
            while spaces and a > done and self.text[a - 1] == " ":
                a -= 1
            text += [self.text[done:a], new]
            begin += self.begin[done:a] + array("q", [self.begin[a]]) * len(new)
            end += self.end[done:a] + array("q", [self.end[b - 1]]) * len(new)
            done = b
        if done:
            self.text, self.begin, self.end = "".join(text) + self.text[done:], begin + self.begin[done:], end + self.end[done:]

    def digits(self) -> None:
        """Spelled digits become digits; a run needs two number words, and its gaps go."""

        def say(m: re.Match) -> str | None:
            words = re.split(GAP, m[0].lower())
            if sum(w in NUMBERS for w in words) < 2:
                return None
            return "".join("+" if w == "plus" else str(NUMBERS.index(w)) if w in NUMBERS else w for w in words)

        self.rewrite(SPELLED, say)


def _plain(m: re.Match) -> str:
    char = m[0]
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    return str(unicodedata.decimal(char)) if char.isdecimal() else unicodedata.normalize("NFKC", char)


def deobfuscated(text: str) -> Tape | None:
    """The text with disguises undone, or None when it has none."""
    low = text.lower()
    odd = not text.isascii() and DISGUISED.search(text)
    spelled = any(w in low for w in NUMBERS) and len(NUMBER_WORD.findall(text)) > 1
    hidden = BRACKETED.search(text) or ("dot" in low and DOTTED.search(text))
    if not (odd or spelled or hidden):
        return None
    tape = Tape(text)
    if odd:
        tape.rewrite(DISGUISED, _plain)
    tape.rewrite(BRACKETED, lambda m: "@" if m[1].lower() in ("at", "@") else ".", spaces=True)
    tape.rewrite(SPOKEN, lambda m: "@")
    # a spoken dot counts where an at sign or a digit stands on its line, so prose about dots stays as it is
    if "@" in tape.text or DIGIT.search(tape.text) or spelled:
        tape.rewrite(DOTTED, lambda m: ".")
    tape.digits()
    return tape


def personal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), base kinds first 4; hidden kinds only where the source differs from what was read and no base span lies."""
    found = identifiers(text)
    tape = deobfuscated(text)
    if tape is not None:
        base = Covered((a, b) for a, _, b in found)
        for a, kind, b in identifiers(tape.text):
            start, end = tape.begin[a], tape.end[b - 1]
            if text[start:end] != tape.text[a:b] and not base.meets(start, end):
                found.append((start, kind + 4, end))
    return sorted(found)


def scan_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every document: doc_id, counts per kind, base_sha256, spans (kind:start:end in code points).

    Base kinds are found in the text as it stands and always stay; hidden kinds are found after homoglyphs, invisible characters,
    spelled digits and at/dot disguises are undone, and carry the span of the source. Null is empty; an empty text has no spans.
    Texts are read whole, each row gives one row, other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return read.mapInArrow(_scanner(personal_spans, KINDS, 4), f"doc_id {kind}, {counts}, base_sha256 string, spans string")
