"""Invented text."""


def prose(rng, words):
    return " ".join("".join(rng.choice(("an", "er", "th", "ou", "re", "st", "li", "mo")) for _ in range(rng.randint(1, 4))) for _ in range(words))
