"""Fixture texts."""



WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS)[:3] for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, ties, nulls, empty and very long texts, repeated rows."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = prose(2, 60)
    rows = [
        (0, base), (1, base), (2, near), (3, prose(3, 80) + ". " + passage + ". " + prose(4, 20)), (4, prose(5, 50) + ". " + passage + ". " + prose(6, 9)),
        (5, None), (6, ""), (7, "   \n\t "), (8, "one two"), (9, "one two"), (10, "ONE two"), (11, prose(7, 20_000)), (12, "é漢🙂 " * 30), (13, "aaaa " * 200), (14, "a" * 3000),
        (15, "line one is here\n" * 40), (16, base.upper()), (17, "x"), (18, passage), (18, passage), (None, passage), (None, None), (19, "tail\n\n\n  spaced   words here"),
    ]
    return rows


