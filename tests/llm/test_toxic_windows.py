"""A toxic word that only the last of many toxic texts hold is learnt."""

import random

from tidegraph.llm import toxicity


def test_late_words_are_learnt():
    rnd = random.Random(2)
    clean = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]

    def text(word=None):
        words = [rnd.choice(clean) for _ in range(240)]
        if word:
            for at in range(10, 240, 48):
                words[at] = word
        return " ".join(words).encode()

    texts = [text("idiot") for _ in range(560)] + [text("zorgnak") for _ in range(80)] + [text() for _ in range(500)]
    field = toxicity.fit(texts, [1] * 640 + [0] * 500)
    for word in ("idiot", "zorgnak"):
        words = [w.encode() for w in rnd.choices(clean, k=20)] + [word.encode()] + [w.encode() for w in rnd.choices(clean, k=20)]
        p = field.tag([words])[0]
        assert p[20] > 0.5 and max(p[:20]) < 0.5
