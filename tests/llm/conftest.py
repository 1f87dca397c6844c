import random

import pytest

BASE = ["the", "of", "Und", "año", "être", "naïve", "x-ray,", "end.", "Ünter", "42", "gnu", "mit", "license"]


@pytest.fixture(scope="session")
def words():
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(BASE) + str(r.randrange(400)) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
