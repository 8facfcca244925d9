"""Plain sequential models of the stateful rules, used as references in tests."""

from collections import defaultdict, deque


def flows(packets, idle_us=60_000_000, cap=1000):
    """[(first_seq, src, dst, fwd, bwd, bytes, start, end, reason or None)] in any order."""
    live, done = {}, []
    for seq, ts, src, sport, dst, dport, proto, length, flags in sorted(packets, key=lambda p: (p[1], p[0])):
        ends = sorted([(src, sport), (dst, dport)])
        key = (*ends, proto)
        f = live.get(key)
        if f and ts - f["end"] > idle_us:
            done.append(f | {"reason": "idle"})
            f = None
        if f is None:
            f = live[key] = dict(seq=seq, a=(src, sport), b=(dst, dport), fwd=0, bwd=0, bytes=0, start=ts)
        f["fwd" if (src, sport) == f["a"] else "bwd"] += 1
        f["bytes"] += length
        f["end"] = ts
        if "F" in flags or "R" in flags or f["fwd"] + f["bwd"] >= cap:
            done.append(live.pop(key) | {"reason": "fin_rst" if set("FR") & set(flags) else "cap"})
    return done + [f | {"reason": None} for f in live.values()]


def throttle(rows, limit, window):
    """Ids kept, rows are (key, time, id)."""
    kept, recent = set(), defaultdict(deque)
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        q = recent[key]
        while q and t - q[0] >= window:
            q.popleft()
        if len(q) < limit:
            q.append(t)
            kept.add(i)
    return kept


def sliding(rows, width):
    """id -> count of rows of its key in [t - width, t] seen so far; rows are (key, t, id)."""
    out, seen = {}, defaultdict(list)
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[key].append(t)
        out[i] = sum(1 for x in seen[key] if t - x <= width)
    return out


def distinct_ports(rows, width):
    """id -> distinct ports of its source in the window; rows are (src, t, id, port)."""
    out, seen = {}, defaultdict(list)
    for src, t, i, port in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[src].append((t, port))
        out[i] = len({p for x, p in seen[src] if t - x <= width})
    return out
