"""Plain loops that the series operators are held against."""

import math
import statistics


def sma(x, n):
    return [sum(x[i - n + 1 : i + 1]) / n if i >= n - 1 and None not in x[i - n + 1 : i + 1] else None for i in range(len(x))]


def ema(x, span):
    alpha, out, value, weight, seen = 2 / (span + 1), [], None, 1.0, 0
    for v in x:
        if v is None:
            weight *= 1 - alpha
            out.append(None)
            continue
        seen += 1
        if value is None:
            value = v
        else:
            weight *= 1 - alpha
            value = (weight * value + alpha * v) / (weight + alpha)
        weight = 1.0
        out.append(value if seen >= span else None)
    return out


def rsi(x, p=14):
    gains, losses, out, g, s = [], [], [None], None, None
    for a, b in zip(x, x[1:], strict=False):
        up, down = max(b - a, 0.0), max(a - b, 0.0)
        gains.append(up)
        losses.append(down)
        if len(gains) < p:
            out.append(None)
            continue
        if len(gains) == p:
            g, s = sum(gains) / p, sum(losses) / p
        else:
            g, s = (g * (p - 1) + up) / p, (s * (p - 1) + down) / p
        out.append(50.0 if g == s == 0 else 100.0 if s == 0 else 0.0 if g == 0 else 100 - 100 / (1 + g / s))
    return out


def volatility(x, n=30):
    r = [None, *[math.log(b / a) for a, b in zip(x, x[1:], strict=False)]]
    return [statistics.stdev(r[i - n + 1 : i + 1]) * math.sqrt(252) if i >= n else None for i in range(len(x))]
