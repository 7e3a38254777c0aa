"""Plain-Python statement of the matching rules, character by character."""

import re
import string

WORD = set(string.ascii_letters + string.digits + "_")


def keyword_hits(text, keywords):
    """All whole-word hits, left to right, longest at each start."""
    spelling = {k.lower(): k for k in keywords}
    low, hits, i = text.lower(), [], 0
    while i < len(low):
        if i and low[i - 1] in WORD:
            i += 1
            continue
        best = ""
        for k in spelling:
            end = i + len(k)
            if len(k) > len(best) and low.startswith(k, i) and (end == len(low) or low[end] not in WORD):
                best = k
        if best:
            hits.append(spelling[best])
            i += len(best)
        else:
            i += 1
    return hits


def rule(text, banks):
    low = text.lower()
    for p in banks.patterns.patterns:
        if re.search(p.pattern, low, re.IGNORECASE | re.UNICODE):
            return "Malign", f"bypass:{p.id}"
    for label, bank in (("Crisis", banks.crisis), ("Malign", banks.malign)):
        hits = keyword_hits(text, [e.keyword for e in bank.entries])
        if hits:
            return label, f"keyword:{hits[0]}"
    return "Valid", None
