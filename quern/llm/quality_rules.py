"""Quality rules, line first: lines that fail are removed, then documents that lost too much are rejected."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset("|»›>•·")
MIN_WORDS = 50
#: A document is rejected if fewer of its words are left than one in LOSS.
LOSS = 2
#: Phrases that mark a line as boilerplate, in the languages of the corpus, where they are one in SHARE of its words; other
#: languages are a parameter. A sentence that merely has such words stays.
BOILERPLATE = (
    "accept cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "enable javascript", "click here", "subscribe to our", "sign up for", "log in to",
    "powered by", "share this", "lorem ipsum",
    "cookies akzeptieren", "verwendet cookies", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken",
    "newsletter abonnieren", "jetzt anmelden", "artikel teilen",
    "accepter les cookies", "utilise des cookies", "politique de confidentialité", "mentions légales", "tous droits réservés", "cliquez ici",
    "abonnez-vous", "partager cet article",
    "aceptar cookies", "utiliza cookies", "política de privacidad", "aviso legal", "todos los derechos reservados", "haga clic",
    "suscríbete", "compartir este",
)
SHARE = 4
#: A line ends in a terminal mark, closing quotes and brackets aside; a line of so many words may do with one inside.
PARAGRAPH = 20
TERMINAL = r"""[.!?:;…]["'”’»)\]]*\z"""
_TERMINAL = re.compile(TERMINAL.replace(r"\z", r"\Z"))
_MARK = re.compile("[.!?]")
_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
SPACES = " \t\n\x0b\x0c\r"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept_words long, kept boolean, clean_md5 string, clean string"


def repeat_words(words: list[bytes]) -> int:
    """Words within 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pairs = w[:-1] * len(ids) + w[1:]
    if len(ids) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, code, counts = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = np.r_[counts[code] > 1, False, False]
    return int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())


def phrases(found: Sequence[str] = BOILERPLATE) -> re.Pattern[str]:
    return re.compile("|".join(map(re.escape, found)))


def line_fails(line: str, boilerplate: re.Pattern[str] | None = None) -> bool:
    """Whether one line that holds a word breaks a rule."""
    line = line.strip(SPACES)
    words = line.encode().split()
    n = len(words)
    if not _TERMINAL.search(line) and (n < PARAGRAPH or not _MARK.search(line)):
        return True
    separators = sum(line.count(c) for c in SEPARATORS) and sum(w.decode() in SEPARATORS for w in words)
    if separators >= 3 and 5 * separators >= n:
        return True
    if 2 * sum(map(line.count, SYMBOLS)) >= n:
        return True
    if n >= 3 and not _LOWER.search(line) and _UPPER.search(line):
        return True
    if n >= 10 and 3 * len(set(words)) < n:
        return True
    return is_boilerplate(line.lower(), n, boilerplate or phrases())


def is_boilerplate(line: str, n: int, boilerplate: re.Pattern[str]) -> bool:
    """Whether phrases, each counted once, make up one in SHARE of a line's n words."""
    if boilerplate.search(line) is None:
        return False
    found = {m.group(1) for m in re.finditer(f"(?=({boilerplate.pattern}))", line)}
    return SHARE * sum(len(p.split()) for p in found) >= n


def judged(text: str | None, boilerplate: re.Pattern[str]) -> tuple:
    """The values of COLUMNS for one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    good = [x for x in lines if not line_fails(x, boilerplate)]
    clean = "\n".join(good)
    left = sum(len(x.encode().split()) for x in good)
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
        failed, left, not failed and LOSS * left >= n, hashlib.md5(clean.encode()).hexdigest(), clean,
    )


def clean(docs: DataFrame, texts: bool = True, boilerplate: Sequence[str] = BOILERPLATE) -> DataFrame:
    """Every row of ``docs`` as ``doc_id`` and COLUMNS; ``clean`` is the text left, or null without ``texts``, and
    ``clean_md5`` its digest.

    A line without a word neither passes nor fails and is dropped. A line fails that does not end in a terminal mark
    (and is short or has none inside), is a navigation bar, is full of symbols or in capitals, repeats few words, or has
    phrases of ``boilerplate`` for one in SHARE of its words at least. A document is kept if its base counts pass and half of its words at
    least are left; exactly half is enough. A null, empty or blank text has no words, no text left, and is rejected; a
    text of any length is read whole, by one task. Repeated rows are judged one by one and an empty table gives an
    empty result; columns other than doc_id and text are ignored, whatever their names.
    """
    found = phrases(boilerplate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.string())
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for b in batches:
            rows = [judged(t.as_py(), found) for t in b.column("text")]
            cols = [pa.array([r[k] for r in rows] if texts or k < 9 else [None] * len(rows), kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + COLUMNS)
