"""The operators again in plain Python, one document or pair after another."""

import collections
import datetime
import functools
import hashlib
import hmac
import re
import zlib

import numpy as np
import regex

from folioscan.llm import decontaminate, pii, quality_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


# ---- tokens


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pieces(path, rows, capacity=2048):
    """(doc_id, piece, start, length, crc32) of every document."""
    out = []
    for doc_id, text in rows:
        ids = ids_of(path, text)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out)


def packed_well(rows, capacity=2048):
    """Checks places, and that there are no more sequences than best-fit-decreasing makes."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    free = []
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(capacity - n)
    assert len(by) <= len(free)


# ---- personal data


def keyed(key, *parts):
    return int(hmac.new(key.encode(), "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:15], 16)


def feistel(value, left, right, key, *tweak):
    a, b = divmod(value, right)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + keyed(key, *tweak, i, b) % left) % left
        else:
            b = (b + keyed(key, *tweak, i, a) % right) % right
    return a * right + b


def digits(d, key, kind):
    n, low = len(d), len(d) // 2
    return str(feistel(int(d), 10 ** (n - low), 10**low, key, kind, n)).zfill(n)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def laid_out(template, d):
    left = iter(d)
    return "".join(next(left) if c.isdigit() else c for c in template)


def card(m, key):
    d = re.sub("[^0-9]", "", m)
    if not luhn(d):
        return None
    body = digits(d[:-1], key, "card")
    return laid_out(m, body + next(c for c in "0123456789" if luhn(body + c)))


def date(m, form, key):
    try:
        day = datetime.datetime.strptime(m, form).date()
    except ValueError:
        return None
    v = (day - datetime.date(1900, 1, 1)).days
    if not 0 <= v < 73049:
        return None
    while True:
        v = feistel(v, 512, 256, key, "date")
        if v < 73049:
            return (datetime.date(1900, 1, 1) + datetime.timedelta(v)).strftime(form)


def ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    if not area or area == 666 or area >= 900 or not group or not serial:
        return None
    v = feistel(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    upper, low = divmod(v, 9999)
    at, middle = divmod(upper, 99)
    return f"{at + (2 if at >= 665 else 1):03}-{middle + 1:02}-{low + 1:04}"


def address(m, key):
    parts = list(map(int, m.split(".")))
    if max(parts) > 255:
        return None
    v = feistel(int.from_bytes(bytes(parts), "big"), 65536, 65536, key, "ip")
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def pseudonym(m, key):
    """Replacement and how many items were found."""
    whole = lambda p: regex.fullmatch(p, m) is not None
    digest = lambda kind: hmac.new(key.encode(), f"{kind}|{m.lower()}".encode(), hashlib.sha256).hexdigest()
    if whole(pii._CARD) and re.search("[ -]", m):
        groups, out, n, i = re.findall("[0-9]+[ -]?", m), "", 0, 0
        while i < len(groups):
            stretches = (("".join(groups[i : i + k]), k) for k in (5, 4, 3, 2) if i + k <= len(groups))
            found = next(((c, k) for w, k in stretches if (12 if k == len(groups) else 13) <= len(re.sub("[^0-9]", "", w)) <= 19 and (c := card(w, key))), None)
            out, n, i = (out + found[0], n + 1, i + found[1]) if found else (out + groups[i], n, i + 1)
        return out, n
    if "@" in m:
        found = f"p{digest('mail')[:16]}@mail.invalid"
    elif whole(pii._IP):
        found = address(m, key)
    elif whole(pii._ISO_DATE):
        found = date(m, "%Y-%m-%d", key)
    elif whole(pii._DAY_DATE):
        found = date(m, "%d.%m.%Y" if "." in m else "%d/%m/%Y", key)
    elif whole(pii._SSN):
        found = ssn(m, key)
    elif whole(pii._CARD):
        found = card(m, key)
    elif whole(pii._PHONE):
        code = re.match(r"(\+[0-9]{1,3}[ .-]?)?", m).group()
        rest = m[len(code) :]
        found = code + laid_out(rest, digits(re.sub("[^0-9]", "", rest), key, "phone"))
    else:
        found = digest("secret")[: len(m)]
        found = found.upper() if re.search("[A-F]", m) else found
    return (m, 0) if found is None else (found, 1)


def pseudonymised(text, key):
    count = 0

    def change(m):
        nonlocal count
        new, n = pseudonym(m.group(), key)
        count += n
        return new

    return (None if text is None else regex.sub(pii.PATTERN, change, text)), count


# ---- lines


def without_spread_lines(rows, min_sites):
    """(doc_id, text, number of lines with a word, number removed) of rows (doc_id, source, text)."""
    normal = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    sites, holder = collections.defaultdict(set), {}
    for doc_id, source, text in rows:
        for x in filter(None, map(normal, (text or "").split("\n"))):
            sites[x].add(source)
            holder[x] = min(holder.get(x, doc_id), doc_id)
    out = []
    for doc_id, _, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (y := normal(x)) or len(sites[y] - {None}) < min_sites or holder[y] == doc_id]
        inked = sum(1 for x in lines if normal(x))
        out.append((doc_id, None if text is None else "\n".join(kept), inked, inked - sum(1 for x in kept if normal(x))))
    return out


# ---- classes of similar sets


def classes(rows, n, num, den):
    """doc_id -> (size of its set, smallest id reached by links)."""
    sets = []
    for _, t in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and den * small >= num * large:
                both = len(sets[i] & sets[j])
                if den * both >= num * (small + large - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)}


# ---- quality


def quality_scores(rows, labels):
    """doc_id -> score, from all rows at once: ridge by least squares on stacked equations, isotonic by the max-min formula."""
    fold = {k: {0: 0, 2: 1}.get(zlib.crc32(str(k).encode()) % 3) for k, _ in rows}
    stats = {k: np.array(quality_model.statistics(t)) for k, t in rows}
    known = [k for k, _ in rows if fold[k] is not None and labels.get(k) is not None]
    x = np.array([stats[k] for k in known])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = lambda v: quality_model._fourier((v - mean) / scale)
    a, y, part = z(x), np.array([float(labels[k]) for k in known]), np.array([fold[k] for k in known])

    def ridge(rows_of):
        penalty = np.full(a.shape[1], quality_model.RIDGE * max(1, rows_of.sum()))
        penalty[-1] = 1e-9
        stacked = np.vstack([a[rows_of], np.diag(np.sqrt(penalty))])
        return np.linalg.lstsq(stacked, np.concatenate([y[rows_of], np.zeros(a.shape[1])]), rcond=None)[0]

    cross = np.where(part == 0, a @ ridge(part == 1), a @ ridge(part == 0))
    at = np.clip(((cross + 0.5) / 2 * quality_model.BINS).astype(int), 0, quality_model.BINS - 1)
    bins = np.unique(at)
    weight = np.array([(at == b).sum() for b in bins], float)
    centre, level = (np.array([v[at == b].mean() for b in bins]) for v in (cross, y))
    n = len(bins)
    block = lambda i, j: (weight[i : j + 1] * level[i : j + 1]).sum() / weight[i : j + 1].sum()
    fitted = np.array([max(min(block(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    knots = {v: np.average(centre[np.isclose(fitted, v)], weights=weight[np.isclose(fitted, v)]) for v in np.unique(np.round(fitted, 12))}
    levels = np.array(sorted(knots))
    raw = {k: float((z(s[None]) @ ridge(np.ones(len(known), bool)))[0]) for k, s in stats.items()}
    return {k: float(np.clip(0.999 * np.interp(r, [knots[v] for v in levels], levels) + 0.001 / (1 + np.exp(-8 * (r - 0.5))), 0, 1)) for k, r in raw.items()}


# ---- test items


def copies(rows, items, min_score):
    """{(doc_id, item_id): (score, ...)} of all documents against all items, each aligned in full."""
    hashed = {k: decontaminate.word_hashes(t) for k, t in items}
    out = {}
    for doc_id, text in rows:
        own = decontaminate.word_hashes(text)
        for item, words in hashed.items():
            # an alignment has no more matches than words in common
            if len(words) and np.isin(words, own).sum() >= min_score * len(words):
                score, _, _ = decontaminate.align(words, own)
                if score >= min_score * 2 * len(words):
                    out[doc_id, item] = score / (2 * len(words))
    return out


# ---- conversations


def damaged(rows):
    """(conv, turn, role, text) after the damage of the query, in order; every conversation stays known."""
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, *t[1:])) for conv, turns in out.items()}


def cheapest_edits(turns):
    """(cost, edits) by going from every state through all edits, from the end to the front; turns are (role initial, fault)."""

    @functools.cache
    def best(i, last, inserted):
        ways = [(0, "")] if i == len(turns) and last in ("", "a") else []
        for target in ("u", "a"):
            if inserted < 3 and target in after[last]:
                ways.append(grown(best(i, target, inserted + 1), 5, "I"))
        if i < len(turns):
            initial, fault = turns[i]
            ways.append(grown(best(i + 1, last, 0), 2, "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if initial and initial in after[last]:
                    ways.append(grown(best(i + 1, initial, 0), more, "K"))
                for target in "ua":
                    if target in after[last]:
                        ways.append(grown(best(i + 1, target, 0), 1 + more, "R"))
        return min(ways, default=(10**9, ""))

    def grown(rest, cost, letter):
        return rest[0] + cost, letter + rest[1]

    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    return best(0, "", 0)


def repaired(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's turns (turn, role, text)."""
    numbers = {t for t, _, _ in turns if t is not None}
    seen, marked = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role[:1], fault))
    cost, audit = cheapest_edits(tuple(marked))
    lines, last, rest = [], "", list(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else rest.pop(0)[1:]
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if last == "u" else "user"
        lines.append(f"{role}:{text}")
        last = role[:1]
    counts = (sum(f == k for _, f in marked) for k in ("blank", "duplicate", "truncated"))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


# ---- secrets


def base_secrets(text):
    """(start, kind number, end) by plain patterns over the text."""
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_row(text):
    """(n_assign, n_access, n_hex, sha256) of the base spans."""
    spans = base_secrets(text)
    shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(shown.encode()).hexdigest())


# ---- fill in the middle


def middle_row(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seed, n = sha(f"42:{'' if doc_id is None else doc_id}"), len(units)
    h1, h2, h3, h4 = (int(seed[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, mid, tail = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h4 % 100 < 80
    out = f"<S>{tail}<P>{head}<M>{mid}" if spm else f"<P>{head}<S>{tail}<M>{mid}"
    return n, "spm" if spm else "psm", len(head), len(mid), sha(out), sha(text)
