"""Plain sequential loops that the distributed operators must equal."""


def threshold_loop(rows, count, micros, distinct=False):
    """rows: (key, time, id, value); returns the ids that fire."""
    kept, fired = {}, []
    for key, when, row_id, value in sorted(rows, key=lambda r: (r[1], r[2])):
        stamps = kept.setdefault(key, [])
        stamps.append((when, value))
        stamps[:] = [s for s in stamps if when - s[0] < micros]
        size = len({v for _, v in stamps}) if distinct else len(stamps)
        if size >= count:
            fired.append(row_id)
            stamps.clear()
    return sorted(fired)
