import textwrap

from layerlake.llm.licenses import SENTENCES, Recogniser


def test_sentences_over_many_lines():
    r = Recogniser()
    for width in (12, 24, 28, 80):
        for gap in ("\n", "\n * \n * ", "\n#\n#\n#\n# "):
            text = "first line\n" + gap.join(textwrap.wrap(SENTENCES["mit-grant"], width, break_long_words=False, break_on_hyphens=False)) + ":\nlast line"
            assert r.identify(text) == ["mit-grant"]
