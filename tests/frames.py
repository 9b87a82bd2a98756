"""Small frames for tests."""

import random
from datetime import datetime, timedelta

from tickloom.schemas import LEVEL, PROFILE

START = datetime(2024, 1, 1, 9, 30)
BARS = f"""symbol string, DateTime timestamp_ntz, Open double, High double, Low double, Close double, Volume bigint,
Delta bigint, {PROFILE} {LEVEL.simpleString()}""".replace(
    f"{PROFILE} struct", f"{PROFILE} array<struct") + ">"


def at(i: int) -> datetime:
    return START + timedelta(minutes=15 * i)


def level(price, bid=1, ask=2, trades=1):
    return (float(price), bid, ask, bid + ask, trades)


def bar(symbol, i, close=10.0, levels=((10.0, 1, 2, 3, 1),), volume=None, delta=1):
    levels = list(levels)
    total = sum(x[3] for x in levels) if volume is None else volume
    return (symbol, at(i), close, close + 1, close - 1, close, total, delta, levels)


def bar_frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def random_bars(n_hot=400, n_cold=30, seed=3):
    """One symbol has most of the bars, spread over many days with holes; some profiles are empty."""
    rng = random.Random(seed)
    rows = []
    for symbol, n in (("hot", n_hot), ("cold", n_cold), ("once", 1)):
        step = 0
        for _ in range(n):
            step += rng.choice([1, 1, 1, 2, 90, 300])
            prices = rng.sample(range(1, 40), rng.choice([0, 1, 3]))
            levels = [level(p, rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 4)) for p in prices]
            rows.append(bar(symbol, step, float(rng.randint(1, 99)), levels, rng.randint(1, 500),
                            rng.randint(-50, 50)))
    rng.shuffle(rows)
    return rows
