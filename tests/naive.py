"""Plain one-series-at-a-time models to compare with, written row by row."""

import math
import statistics


def states(values, on, off):
    state, out = False, []
    for i, v in enumerate(values):
        if i == 0:
            state = v is not None and v > on
        elif v is not None:
            state = v > on if not state else not v < off
        out.append(state)
    return out


def cycles(values, on, off):
    st, out, start = states(values, on, off), [], None
    for i in range(1, len(values)):
        if st[i] and not st[i - 1]:
            start = i
        if not st[i] and st[i - 1] and start is not None:
            known = [v for v in values[start : i + 1] if v is not None]
            out.append((start, i, max(known), sum(known) / len(known)))
            start = None
    return out


def sign(x):
    return (x > 0) - (x < 0)


def turns(values):
    signs = [0] + [sign(b - a) for a, b in zip(values, values[1:])]
    return [0] + [int(a != b) for a, b in zip(signs, signs[1:])]


def scores(values, window):
    t, out = turns(values), []
    for i in range(len(values)):
        part = values[max(0, i - window + 1) : i + 1]
        freq = sum(t[max(0, i - window + 1) : i + 1]) / len(part)
        mean, swing = sum(part) / len(part), max(part) - min(part)
        std = statistics.stdev(part) if len(part) > 1 else 0.0
        if mean == 0:
            out.append(1.0 if std > 0 or swing > 0 else min(1.0, 2 * freq))
        else:
            out.append(min(1.0, max(0.0, 0.4 * std / mean + 0.4 * swing / mean + 2 * freq)))
    return out


def fluctuations(values, window, threshold):
    sc = scores(values, window)
    high, out, i = [x > threshold for x in sc], [], 0
    while i < len(values):
        if not high[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(values) and high[j + 1]:
            j += 1
        end = min(j + 1, len(values) - 1)
        if end > i:
            part = values[i : end + 1]
            out.append((i, end, sum(sc[i : end + 1]) / len(part), max(part) - min(part), sum(turns(part)), sum(part) / len(part)))
        i = j + 1
    return out


def risks(values):
    out = []
    for i in range(len(values)):
        part = values[max(0, i - 19) : i + 1]
        if i < 4:
            out.append(0.0)
            continue
        jumps = sum(abs(b - a) > 200 for a, b in zip(part, part[1:]))
        raw = 0.4 * statistics.pstdev(part) / 125 + 0.4 * (max(part) - min(part)) / 1000 + 0.2 * jumps / 10
        out.append(min(1.0, raw))
    return out


def runtimes(flags):
    out, n = [], 0
    for f in flags:
        n = n + 1 if f else 0
        out.append(n)
    return out


def closed_loop(wanted, max_actions):
    """wanted: (minute, room, action_no, |delta|, wait) of one site; returns the taken ones."""
    last, out = {}, []
    for now in sorted({w[0] for w in wanted}):
        ready = [w for w in sorted(wanted) if w[0] == now and (w[1] not in last or now - last[w[1]] >= w[4])]
        ready.sort(key=lambda w: -w[3])
        for w in ready[:max_actions]:
            out.append(w[:3])
        for w in ready[:max_actions]:
            last[w[1]] = now
    return sorted(out)


def dbscan(points, eps, min_samples):
    """Core flags and, for core points, component numbers; None for noise and border points."""
    near = [[j for j, q in enumerate(points) if math.dist(p, q) <= eps] for p in points]
    core = [len(n) >= min_samples for n in near]
    comp = [None] * len(points)
    for i in range(len(points)):
        if core[i] and comp[i] is None:
            comp[i], stack = i, [i]
            while stack:
                for k in near[stack.pop()]:
                    if core[k] and comp[k] is None:
                        comp[k] = i
                        stack.append(k)
    reach = [{comp[j] for j in near[i] if core[j]} for i in range(len(points))]
    return core, comp, reach
