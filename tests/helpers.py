"""Plain-Python bars and indicators to test against."""

import random
from datetime import date, timedelta

BAR_SCHEMA = (
    "symbol string, trade_date_market date, open double, high double, low double, close double, volume double"
)


def bar(symbol, day, close, high=None, low=None, open_=None, volume=100.0):
    high = close if high is None else high
    low = close if low is None else low
    return (symbol, day, close if open_ is None else open_, high, low, close, volume)


def random_bars(seed, sizes, gaps=(1, 1, 1, 3, 40, 500)):
    """Histories with dense and sparse stretches, shuffled; ``sizes`` maps symbol to bars."""
    rng, rows = random.Random(seed), []
    for symbol, size in sizes.items():
        day, price = date(1980, 1, 1), 100.0
        for _ in range(size):
            day += timedelta(days=rng.choice(gaps))
            price = max(1.0, price + rng.uniform(-3, 3))
            up, down = rng.uniform(0, 2), rng.uniform(0, 0.9)
            rows.append(bar(symbol, day, price, price + up, price - down, price + up / 2))
    rng.shuffle(rows)
    return rows


def by_symbol(rows):
    histories = {}
    for row in rows:
        histories.setdefault(row[0], []).append(row)
    return {s: sorted(h, key=lambda r: r[1]) for s, h in histories.items()}


def trailing(values, i, n=14):
    window = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
    return sum(window) / len(window) if window else None


def indicators(history):
    """Rows of (tr, atr, plus_di, minus_di, dx, adx) for one symbol in date order."""
    tr, plus, minus, dx, out = [], [], [], [], []
    for i, (_, _, _, high, low, _, _) in enumerate(history):
        if i == 0:
            tr.append(high - low), plus.append(0.0), minus.append(0.0)
        else:
            _, _, _, prev_high, prev_low, prev_close, _ = history[i - 1]
            tr.append(max(high - low, abs(high - prev_close), abs(low - prev_close)))
            up, down = high - prev_high, prev_low - low
            plus.append(up if up > down and up > 0 else 0.0)
            minus.append(down if down > up and down > 0 else 0.0)
        atr = trailing(tr, i)
        pdi = trailing(plus, i) / atr * 100 if atr else None
        mdi = trailing(minus, i) / atr * 100 if atr else None
        total = None if pdi is None else pdi + mdi
        dx.append(abs(pdi - mdi) / total * 100 if total else 0.0)
        out.append((tr[-1], atr, pdi, mdi, dx[-1], trailing(dx, i)))
    return out
