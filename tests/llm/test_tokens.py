"""Words looked up in Arrow arrays: the library's ids, each word merged once, what was asked for of late kept."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from folio.llm import tokens


def test_words_are_merged_once_and_forgotten_by_last_use():
    own, made = tokens.Encoder(tokens.tokenizer_path()), []
    words = tokens.Words(lambda x: made.append(x) or own._letters(x), own.type, most=4)
    for asked in (["a", "bc"], ["bc", "déf"], ["g", "bc"], ["h", "bc"], ["bc", "i"], ["bc", "a"], []):
        at = words.places(pa.array(asked, pa.string()))
        assert [words.ids[int(k)].as_py() for k in at] == [list(memoryview(own._letters(x)).cast("H")) for x in asked]
    # At five words the two of late stay: bc and h.
    assert made == ["a", "bc", "déf", "g", "h", "i", "a"]


def test_texts_of_all_kinds_together_have_the_librarys_ids():
    path, r = tokens.tokenizer_path(), random.Random(7)
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    own.words.most = 30
    parts = ["word", "Word,", "naïve.", "it's", "'s", "...", "x1", "12", "a\nb", "\n", "end.\n", "ÿ!?", "_", "a-b", "(see)", "word;", "x.y", "été"]
    texts = ["", None, " ", "a", ",", "a ", " a", "\n", "...", "1 2", ", .", "a, b. c"] + [" ".join(r.choices([*parts, *(f"{p}{chr(97 + k)}" for p in ("w", "v,") for k in range(26))], k=r.randint(1, 30))) for _ in range(300)]
    for at in range(0, len(texts), 11):
        for text, ids in zip(texts[at : at + 11], own(texts[at : at + 11]), strict=True):
            assert list(memoryview(ids).cast("H")) == library.encode(text or "", add_special_tokens=False).ids, text
