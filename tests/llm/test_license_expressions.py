import itertools
import re

import pytest

from layerlake.llm.licenses import Recogniser

SAID = {
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
    "// SPDX-License-Identifier: (MIT AND (BSL-1.0 OR Zlib))\ncode": ["BSL-1.0", "MIT", "Zlib"],
    "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": ["GPL-2.0-only WITH classpath-exception-2-0"],
    "SPDX-License-Identifier: MIT OR GPL-2.0-only WITH Classpath-exception-2.0 AND Zlib": ["GPL-2.0-only WITH classpath-exception-2-0", "MIT", "Zlib"],
    "SPDX-License-Identifier: MIT or nothing known": ["MIT"],
    "SPDX-License-Identifier: MIT\nor so it seems": ["MIT"],
    "This product is not licensed under the MIT License.": [],
    "It used to be released under the MIT License.": [],
    "It is no longer licensed under the MIT License": [],
    "It is not only licensed under the MIT License but good.": ["MIT"],
    "Not a word. Licensed under the MIT License.": ["MIT"],
    "We are not sure what this does. It is released under the MIT License.": ["MIT"],
}


@pytest.mark.parametrize("text", SAID)
def test_expressions_and_denials(text):
    r = Recogniser()
    assert sorted({n for n, _ in r.match(r.identify(text))}) == SAID[text]


def test_expressions_equal_a_plain_parse():
    """Every expression of up to four known identifiers, against splitting the line itself."""
    r = Recogniser()
    ids = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "CC0-1.0"]
    for n in (1, 2, 3, 4):
        for names in itertools.permutations(ids, n):
            for ops in itertools.product(("AND", "OR"), repeat=n - 1):
                line = names[0] + "".join(f" {o} ({x})" if o == "OR" else f" {o} {x}" for o, x in zip(ops, names[1:]))
                want = sorted(set(re.split(r" AND | OR ", line.replace("(", "").replace(")", ""))))
                got = sorted({x for x, _ in r.match(r.identify(f"text\n/* SPDX-License-Identifier: {line} */\nmore"))})
                assert got == want, line
