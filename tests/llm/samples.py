"""Small tables with ties, repeated rows, nulls, copies and long texts."""

import random

VOCABULARY = ["ab", "the", "Stone", "été", "x", "rain", "of", "Äther", "q7", "to", "be", "$5", "日本", "end."]


def texts(seed, n=60, words=120, vocabulary=None):
    """Random texts, many of them stitched from passages of earlier ones."""
    rnd, out = random.Random(seed), []
    vocabulary = vocabulary or VOCABULARY + [f"w{k}" for k in range(400)]
    for k in range(n):
        made = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, words))]
        if out and k % 3:
            other = rnd.choice(out).split(" ")
            a = rnd.randrange(len(other))
            at = rnd.randrange(len(made))
            made[at:at] = other[a : a + rnd.randrange(1, 90)]
        if k % 11 == 5:
            made += [rnd.choice(vocabulary)] * rnd.randrange(30, 80)
        out.append(rnd.choice(["", " ", "\n"]).join(["", rnd.choice([" ", "  ", "\t"])[0].join(made)]) if k % 7 == 0 else " ".join(made))
        if k % 9 == 4:
            out.append(rnd.choice(out))
        if k % 10 == 6:
            near = rnd.choice(out).split(" ")
            near[rnd.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    return out


def rows(seed, **how):
    got = [(k, t) for k, t in enumerate(texts(seed, **how))]
    got += [(len(got), None), (len(got) + 1, ""), (len(got) + 2, " \n\t "), (len(got) + 3, "one"), (len(got) + 4, "one two\nthree")]
    random.Random(seed).shuffle(got)
    return got
