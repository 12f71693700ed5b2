"""Licence notices wrapped over several lines."""

from lakeproof.llm.license_scan import license_scan
from lakeproof.session import ship

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights."""
APACHE = """# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General
 * Public License as published by the Free Software Foundation, either version 3."""
BSD = """Redistribution and use in source and binary forms, with or without\r
modification, are permitted provided that the following conditions\r
are met:"""


def test_wrapped_notices(spark):
    ship(spark)
    far = " ".join(["filler"] * 30)
    scattered = f"released {far}\nunder {far}\nthe {far}\nmit {far}\nlicense"
    texts = [MIT, APACHE, GPL, BSD, f"Title\n\n{far}. {MIT}\n\n{far}", MIT.replace("\n", "\n\n"), scattered]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert [got[i].labels for i in range(7)] == ["mit", "apache", "gpl", "bsd", "mit", "", ""]
    assert all(got[i].score >= 0.8 for i in range(5)) and got[5].score == got[6].score == 0


def test_against_brute_force(spark):
    """All base columns, and every block against every template, over real and broken notices."""
    import re

    import numpy as np

    from lakeproof.llm.license_scan import END, PART_END, PHRASES, TEMPLATES

    ship(spark)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    rng = np.random.default_rng(4)
    texts = [None, "", " ", MIT, MIT, APACHE, GPL, BSD, "word " * 30_000 + "the MIT License, mit license and CC BY", "apache license cc by gnu general public license"]
    for _ in range(150):  # templates with words left out, put in and moved, on one line or more
        own = words(TEMPLATES[rng.choice(list(TEMPLATES))])
        own = [w for w in own if rng.random() > rng.choice([0.0, 0.1, 0.25])] + [f"x{rng.integers(9)}" for _ in range(rng.integers(4))]
        rng.shuffle(own[: rng.integers(len(own) + 1)])
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ". ", "\n\n"], p=[0.3, 0.3, 0.3, 0.06, 0.02, 0.02]) for w in own))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double")).collect()}
    some = 0
    for i, t in enumerate(texts):
        own, starts, labels = words(t), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(own) - len(p) + 1) if own[j : j + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        best, all_labels = 1.0 if starts else 0.0, set(labels)
        low = (t or "").encode().lower()
        for name, template in TEMPLATES.items():
            tokens = set(words(template))
            width = 2 * len(words(template))
            shares = [len(tokens & set(words(b.decode()))) / len(tokens) for b in END.split(low)]
            for block in PART_END.split(low):
                w = words(block.decode())
                if b"\n" in block.strip() and len(tokens & set(w)) >= 0.8 * len(tokens):
                    shares.append(max(len(tokens & set(w[j : j + width])) / len(tokens) for j in range(max(1, len(w) - width + 1))))
            if max(shares) >= 0.8:
                all_labels.add(name.removesuffix("-notice"))
                best = max(best, max(shares))
        want = (len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(all_labels)), best)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, (i, t)
        some += bool(all_labels - labels)
    assert some > 20
