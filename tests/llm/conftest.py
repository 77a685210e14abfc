import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, long ones and odd ones."""
    draw = random.Random(11)
    sentence = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    base = [sentence(draw.randint(1, 120)) for _ in range(60)]
    passage = sentence(30)
    texts = list(base)
    for b in base[:15]:
        words = b.split()
        for edits in (0, 1, 2, 4):
            w = list(words)
            for _ in range(edits):
                w[draw.randrange(len(w))] = draw.choice(WORDS)
            texts.append(" ".join(w))
    texts += [f"{sentence(draw.randint(0, 20))} {passage} {sentence(draw.randint(0, 200))}".strip() for _ in range(25)]
    texts += [None, "", "   \n", "one", "one two three four", "ONE two", "é ü ß", "a" * 5000, sentence(20_000), "x " * 3000, "12 34", "!!!", passage, passage.upper()]
    texts += texts[:5]
    return texts
