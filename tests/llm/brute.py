"""Plain Python versions of what the operators compute, for small inputs."""

import re


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_duplicates(docs, size=5, percent=75):
    """{doc_id: (n_shingles, component_id)} for unique ids."""
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[doc_id] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else (
            {tuple(words)} if words else set())
    index = {}
    for doc_id, s in sets.items():
        for shingle in s:
            index.setdefault(shingle, []).append(doc_id)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for doc_id, s in sets.items():
        shared = {}
        for shingle in s:
            for other in index[shingle]:
                if other < doc_id:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = sorted((root(doc_id), root(other)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def license_places(text):
    """(n_words, n_base, first_word, last_word, base_labels) by a plain scan."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at) if at else None, max(at) if at else None, ",".join(sorted({x for _, x in places})))


def repeats_removed(docs, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} for unique ids."""
    import hashlib

    data = {d: (t or "").encode() for d, t in docs}
    seen, out = set(), {}
    for doc_id in sorted(data):
        text = data[doc_id]
        own = [text[i:i + length] for i in range(len(text) - length + 1)]
        gone = bytearray(len(text))
        for i, string in enumerate(own):
            if string in seen:
                gone[i:i + length] = b"\x01" * length
        seen.update(own)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = len([1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])])
        out[doc_id] = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def shared_heads(rows, group=100, most=6):
    """{conv_id: [(role, text), ...]} of the rebuilt conversations; ``rows`` are (conv_id, turn, role, text)."""
    import zlib

    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - (c % group if c >= 0 else -(-c % group))
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def prefix_trie(conversations):
    """Rows (conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of {conv_id: turns}."""
    import hashlib

    members, out = {}, []
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = sorted(c for c in members[node] if len(conversations[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
                    leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def pii_values(text):
    """Best weight of values in a short text, over all substrings and all ways to choose among them."""
    import datetime

    from tallyloom.llm.pseudonyms import luhn, usual_card

    def weight(a, b):
        part, before, after = text[a:b], text[a - 1:a], text[b:b + 1]
        digits = "".join(c for c in part if c.isdigit())
        most = 0
        if after.isdigit():
            return 0
        if re.fullmatch(r"\d+(?:([ -])\d+(?:\1\d+)*)?", part) and 13 <= len(digits) <= 19 and not re.match(r"[\d.]", before) and digits.strip("0"):
            if luhn(digits[:-1]) == int(digits[-1]):
                usual = usual_card(digits, [len(x) for x in re.split("[ -]", part)])
                most = len(digits) * (8 if usual else 1)
        if re.fullmatch(r"(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}", part) and not re.match(r"[\d.+]", before):
            most = max(most, 80)
        if re.fullmatch(r"1[ .-](?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}", part) and not re.match(r"[\d.+]", before):
            most = max(most, 88)
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", part) and not re.match(r"[\d-]", before) and after != "-":
            if 0 < int(part[:3]) < 900 and part[:3] != "666" and part[4:6] != "00" and part[7:] != "0000":
                most = max(most, 72)
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", part) and not re.match(r"[\d./-]", before):
            try:
                most = max(most, 64 if 1900 <= datetime.date.fromisoformat(part).year < 2100 else 0)
            except ValueError:
                pass
        return most

    usual = {a for a in range(len(text)) for b in range(a + 13, min(len(text), a + 20) + 1)
             if re.fullmatch(r"\d+(?:([ -])\d+(?:\1\d+)*)?", text[a:b]) and weight(a, b) >= 104 and len(re.findall(r"\d", text[a:b])) in (14, 15, 16)}
    best = [0] * (len(text) + 1)
    for b in range(1, len(text) + 1):
        best[b] = best[b - 1]
        for a in range(max(0, b - 40), b):
            own = weight(a, b)
            # From a start that has a usual card only that is read.
            if own and not (a in usual and own in range(13, 20) and own == len(re.findall(r"\d", text[a:b]))):
                best[b] = max(best[b], best[a] + own)
    return best[-1]


def divergence(docs, at_least, top):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source)."""
    counts, spread, groups = {}, {}, set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        for term in terms:
            counts[lang, source, term] = counts.get((lang, source, term), 0) + 1
        for term in set(terms):
            spread[lang, term] = spread.get((lang, term), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (own, t), many in spread.items() if own == lang and many >= at_least]
        sources = sorted(s for own, s in groups if own == lang)

        def shares(held):
            total = sum(held(t) for t in kept)
            return {t: 1 + 10**9 * (held(t) + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(lambda t: sum(counts.get((lang, s, t), 0) for s in sources))
        p = {s: shares(lambda t, s=s: counts.get((lang, s, t), 0)) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts.get((lang, s, t), 0) and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return out
