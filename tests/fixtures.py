"""A small made-up log with the edge cases that splits, histories and features must get right."""

from __future__ import annotations

import random

#: user: (ratings, place of a burst of equal times, where its times start)
USERS = {1: (20, None, 0), 2: (20, 10, 0), 3: (30, None, 0), 4: (25, None, 0), 5: (20, None, 5_000_000), 6: (22, 14, 5_000_000), 7: (8, None, 0), 8: (30, 0, 0), 9: (25, None, 0)}
COLUMNS = "user_id long, item_id long, rating double, ts long"


def log(seed: int = 11) -> list[tuple[int, int, float, int]]:
    rng, rows = random.Random(seed), []
    for user, (n, burst, start) in USERS.items():
        now = 1_000_000_000 + start + user
        for place, item in enumerate(rng.sample(range(1, 40), n)):
            if burst is None or not burst < place < burst + 6:
                now += rng.randint(1, 90_000)
            rating = rng.choice([x / 2 for x in range(1, 11)])
            if user == 4 and place >= n - 6:
                rating = 2.0
            rows.append((user, item, rating, now))
    return rows


def items() -> list[tuple[int, str, str]]:
    names = ["Drama", "Comedy", "Crime", "War"]
    rng = random.Random(3)
    return [(i, f'The "{i}", a title', "(no genres listed)" if i == 40 else "|".join(rng.sample(names, rng.randint(1, 3)))) for i in range(1, 41)]
