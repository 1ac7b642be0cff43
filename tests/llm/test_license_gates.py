import random
import re
from re import _constants as c
from re import _parser

from umbra.llm import licenses


def made(parsed, rng, blank):
    """A string that the parsed expression matches, with `blank` for each run of blanks; what looks around is left out."""
    out = ""
    for op, arg in parsed:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.IN:
            kind, first = rng.choice([x for x in arg if x[0] is not c.NEGATE])
            out += blank if first is c.CATEGORY_SPACE else "w" if kind is c.CATEGORY else chr(first if kind is c.LITERAL else first[0])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            out += "".join(made(inner, rng, blank) for _ in range(rng.randint(low, min(high, low + 1))))
        elif op is c.SUBPATTERN:
            out += made(arg[-1], rng, blank)
        elif op is c.BRANCH:
            out += made(rng.choice(arg[1]), rng, blank)
        elif op is c.NOT_LITERAL:
            out += "x"
        else:
            assert op in (c.ASSERT, c.ASSERT_NOT, c.AT), op
    return out


def test_gates_and_keywords_hold_for_matches_with_newlines():
    rng = random.Random(7)
    for r in licenses.rules():
        parsed = _parser.parse(r.pattern)
        for _ in range(60):
            text = made(parsed, rng, "\n")
            if r.gate == "spdx-":
                text = f"SPDX-License-Identifier: {text}"
            low = re.sub(r"\s+", " ", text.lower())
            assert r.gate in low and r.keyword in low, (r, text)


def test_wrapped_texts_are_found(spark):
    texts = {
        "isc": "Permission to use, copy, modify, and distribute this software for any\npurpose",
        "zlib": "This software is provided 'as-is', without any express or implied\n  warranty",
        "lgpl": "GNU Lesser General\nPublic License",
        "afl": "Academic\r\n Free License",
        "wtfpl": "Do What The Fuck You\nWant To Public License",
        "mit": "Expat-style license",
    }
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).collect()
    for r in found:
        label = list(texts)[r.doc_id]
        assert label in r.labels.split(","), (label, r)
        assert r.score >= 0.8
