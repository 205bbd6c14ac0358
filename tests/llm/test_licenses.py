import re

from lithos.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += own
        if own:
            labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LINES = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "the mit license and the MIT License", "Apache, License", "cc\nby cc-by", "gnu general public", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "élan licence", ""]


def test_base_equals_brute_force(spark, docs, texts):
    more = spark.createDataFrame([(1000 + i, x * 3) for i, x in enumerate(LINES)], "doc_id long, text string")
    out = licenses.scan(docs.select("doc_id", "text", "label", "words").unionByName(more, allowMissingColumns=True)).collect()
    want = sorted((brute(t) for _, t in [*texts, *((0, x * 3) for x in LINES)]), key=str)
    assert sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str) == want
    for r in out:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_labels_of_the_index(spark, no_docs):
    df = spark.createDataFrame([(i, "some words " * 20 + x) for i, x in enumerate(LINES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got[0] == "cc-by,cc-by-nc-4.0" and got[1] == "gpl,gpl-3.0" and got[6] == "mit" and got[7] == ""
    assert licenses.scan(no_docs).count() == 0


def test_changed_key_phrase_is_not_verified(spark):
    df = spark.createDataFrame([(0, "Licensed under the Apache Licence, Version 2.0")], "doc_id long, text string")
    assert licenses.scan(df).first().labels == ""


#: The notices' first sentences as they stand in files, and with words put in or left out.
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
REAL = [
    (MIT, "mit"),
    (MIT.replace("any person obtaining", "any person or company obtaining"), "mit"),
    (MIT.replace('(the "Software")', ""), "mit"),
    (ISC, "isc"),
    (ISC.replace("and/or", "and"), "isc"),
    (BSD, "bsd"),
    (BSD.replace("Redistribution and use in", "Redistribution and use of this software in"), "bsd"),
    (BSD.replace("source and binary forms, with or without modification,", "any form"), ""),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
]


def test_real_notices_and_small_edits(spark):
    df = spark.createDataFrame([(i, "some words here " * 9 + x + " and more" * 5) for i, (x, _) in enumerate(REAL)] + [(100, MIT), (101, MIT + "\n" + BSD + "\n" + MIT)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(len(REAL))] == [want for _, want in REAL]
    assert got[100].labels == "mit" and [(x.label, x.first_word) for x in got[100].spans] == [("mit", 0)]
    n, m = len(licenses.words_of(MIT.encode())), len(licenses.words_of(BSD.encode()))
    assert [(x.label, x.first_word) for x in got[101].spans] == [("mit", 0), ("bsd", n), ("mit", n + m)]
