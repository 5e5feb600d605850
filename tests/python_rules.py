"""Row rules checked another way: every lexicon entry is looked for at every position of one walk
along the text, with the place where its next match may begin."""

from vetolex.functions import lexicons as L


def walk(text, entries):
    """Non-overlapping matches of each entry, all counted in a single left-to-right walk."""
    free = {e: 0 for e in entries}
    found = dict.fromkeys(entries, 0)
    by_first = {}
    for e in found:
        by_first.setdefault(e[0], []).append(e)
    for i, c in enumerate(text):
        for e in by_first.get(c, ()):
            if free[e] <= i and text.startswith(e, i):
                found[e] += 1
                free[e] = i + len(e)
    return found


def features(text):
    """(emoji_pos, emoji_neg, word_pos, word_neg) of the default lexicons; entries of several code points are no emojis."""
    signal = []
    for emojis, emoticons in ((L.POSITIVE_EMOJIS, L.POSITIVE_EMOTICONS), (L.NEGATIVE_EMOJIS, L.NEGATIVE_EMOTICONS)):
        hits = walk(text, {*[e for e in emojis if len(e) == 1], *emoticons})
        signal.append(10 * sum(hits.values()))
    for words in (L.POSITIVE_WORDS, L.NEGATIVE_WORDS):
        signal.append(sum(n > 0 for n in walk(text.lower(), set(words)).values()))
    return tuple(signal)


def tokens(text):
    """Runs of two or more letters, digits and underscores of the lower-cased text."""
    out, run = [], ""
    for c in text.lower() + " ":
        if c.isalnum() or c == "_":
            run += c
            continue
        if len(run) > 1:
            out.append(run)
        run = ""
    return out


def ngrams(toks):
    return [*toks, *(" ".join(toks[i:i + 2]) for i in range(len(toks) - 1))]
