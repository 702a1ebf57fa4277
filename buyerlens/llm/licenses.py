"""License scans by template-markup matching.

A template is license wording with markup: ``<<beginOptional>>`` … ``<<endOptional>>`` may be absent,
``<<var;words=a-b>>`` stands for a to b words of any kind, ``<<either;x|y>>`` for one of several wordings.
Each is compiled to an automaton over words that accepts a place only if all mandatory wording stands there, word
for word and in order; case and signs never matter. A template's longest stretch of mandatory words is looked for first,
so the automaton runs only on texts that can match.

Base phrases are matched as they stand. ``score`` is the share of a text's words covered by accepted places.

Defined cases: a null or empty text has no words, no labels and score 0; null ids and repeated rows are ordinary rows;
an empty table gives no rows; other columns are ignored; a text is scanned whole, however long.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from buyerlens.llm.text import per_chunk

# The phrases and labels of the base scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}



def _item(number: int) -> str:
    return f"<<beginOptional>><<either;{number}|{'_abcd'[number]}>><<endOptional>> "


# Parts of whole licenses.
_MIT_OPENING = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;words=1-3>> and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction"
)
_MIT = (
    _MIT_OPENING + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, ",
    "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be "
    "included in all copies or substantial portions of the Software. ",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1-12>> BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "<<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the "
    "following conditions are met"
)
_BSD = (
    _BSD_OPENING + ": " + _item(1) + "Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. " + _item(2) + "Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ",
    "Neither the name of <<var;words=1-12>> nor the names of <<either;its|their|the>> contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY <<var;words=1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "<<var;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ISC_OPENING = (
    "Permission to use, copy, modify, <<beginOptional>><<either;and/or|and>><<endOptional>> distribute this software for any "
    "purpose with or without fee is hereby granted"
)

# Wordings of public licenses and notices, by label. An opening alone is a notice: other terms may follow it.
TEMPLATES = {
    "mit": (
        _MIT[0] + "subject to the following conditions: " + _MIT[1] + _MIT[2],
        "<<either;released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> "
        "<<beginOptional>>permissive<<endOptional>> MIT License",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>",
        "<<either;released|distributed>> under the <<beginOptional>>terms of the<<endOptional>> Apache License, "
        "<<beginOptional>>Version<<endOptional>> 2.0",
    ),
    "mit-notice": (_MIT_OPENING,),
    "mit-0": (_MIT[0] + _MIT[2],),
    "json": (_MIT[0] + "subject to the following conditions: " + _MIT[1] + "The Software shall be used for Good, not Evil. " + _MIT[2],),
    "bsd-2-clause": (_BSD[0] + _BSD[2],),
    "bsd-3-clause": (_BSD[0] + _item(3) + _BSD[1] + _BSD[2],),
    "bsd-4-clause": (
        _BSD[0] + _item(3) + "All advertising materials mentioning features or use of this software must display the following "
        "<<either;acknowledgement|acknowledgment>>: This product includes software developed by <<var;words=1-24>> "
        + _item(4) + _BSD[1] + _BSD[2],
    ),
    "bsd-notice": (_BSD_OPENING,),
    "isc": (
        _ISC_OPENING + ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND <<var;words=1-12>> <<either;DISCLAIMS|DISCLAIM>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
        "OF THIS SOFTWARE.",
    ),
    "isc-notice": (_ISC_OPENING,),
    "gpl-3": (
        "<<either;licensed|released|distributed>> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public "
        "License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> "
        "<<beginOptional>>either<<endOptional>> version 3",
    ),
    "gpl-2": (
        "<<either;licensed|released|distributed>> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public "
        "License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> "
        "<<beginOptional>>either<<endOptional>> version 2",
    ),
    "cc-by-nc": (
        "<<either;licensed|released|available>> under <<beginOptional>>a<<endOptional>> "
        "<<either;CC|Creative Commons>> <<either;BY-NC|Attribution-NonCommercial>>",
    ),
    "all-rights-reserved": ("<<beginOptional>>Copyright <<var;words=1-12>><<endOptional>> All rights reserved",),
}

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def spaced(text: bytes) -> bytes:
    """The words of a text, lower case, each after one space, and one space at the end."""
    found = text.translate(_LOWER).split(b" ")
    return b" " + b" ".join(filter(None, found)) + b" "


class Template:
    """An automaton over spaced words, and the mandatory words to look for first."""

    def __init__(self, markup: str):
        pattern, stretches, depth = b"", [b""], 0
        for part in re.split(r"(<<.*?>>)", markup):
            if part == "<<beginOptional>>":
                pattern, depth = pattern + b"(?:", depth + 1
                stretches.append(b"")
            elif part == "<<endOptional>>":
                pattern, depth = pattern + b")?", depth - 1
            elif part.startswith("<<var;words="):
                low, high = part[12:-2].split("-")
                pattern += b"(?: [^ ]+){%s,%s}?" % (low.encode(), high.encode())
                stretches.append(b"")
            elif part.startswith("<<either;"):
                choices = [re.escape(spaced(x.encode())[:-1]) for x in part[9:-2].split("|")]
                pattern += b"(?:" + b"|".join(choices) + b")"
                stretches.append(b"")
            else:
                words = spaced(part.encode()).rstrip()
                pattern += re.escape(words)
                if not depth:
                    stretches[-1] += words
        self.accepts = re.compile(pattern + b"(?= )")
        self.sure = max(stretches, key=len) + b" "

    def places(self, line: bytes) -> list[tuple[int, int]]:
        """First byte and end of each accepted stretch, not overlapping."""
        if self.sure not in line:
            return []
        return [m.span() for m in self.accepts.finditer(line)]


def phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """First byte of every place of a phrase, overlapping ones too."""
    found, at = [], line.find(phrase)
    while at >= 0:
        found.append(at)
        at = line.find(phrase, at + 1)
    return found


def scan(texts: list[bytes], templates: dict[str, list[Template]]) -> list[list]:
    phrases = {b" " + p.encode() + b" ": label for p, label in PHRASES.items()}
    columns: list[list] = [[] for _ in range(7)]
    for text in texts:
        line = spaced(text)
        n = line.count(b" ") - 1 if len(line) > 2 else 0
        base, labels, starts, covered = set(), set(), [], []
        for phrase, label in phrases.items():
            for at in phrase_places(line, phrase):
                word = line.count(b" ", 0, at)
                base.add(label)
                starts.append(word)
                covered.append((word, word + phrase.count(b" ") - 1))
        for label, forms in templates.items():
            for form in forms:
                for a, b in form.places(line):
                    word = line.count(b" ", 0, a)
                    labels.add(label)
                    covered.append((word, word + line.count(b" ", a, b)))
        words, end = 0, 0
        for a, b in sorted(covered):
            words += max(0, b - max(a, end))
            end = max(end, b)
        row = (
            n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), words / n if n else 0.0,
        )
        for column, value in zip(columns, row):
            column.append(value)
    return columns


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Base places and labels, all labels and the score of every row of ``docs``."""
    markup = TEMPLATES if templates is None else templates

    def make():
        compiled = {label: [Template(t) for t in forms] for label, forms in markup.items()}
        return lambda texts: scan(texts, compiled)

    return per_chunk(
        docs, ["doc_id"], "text",
        [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
         ("base_labels", "string"), ("labels", "string"), ("score", "double")],
        make,
    )
