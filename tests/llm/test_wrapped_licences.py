"""Notices that are wrapped over lines."""

from depthline.llm import licences

WRAPPED = {
    1: ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal"),
    2: ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    3: ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"),
    4: ("apache-2.0", "Licensed under the Apache\nLicense,\nVersion 2.0"),
    5: ("mit", "released\nunder\nthe\nMIT\nlicense"),
}


def test_wrapped_notices_are_found(frame):
    rows = [(d, "some text before\n\n" + t + "\nand after it") for d, (_, t) in WRAPPED.items()]
    far = " ".join(["released under the", *["word"] * 30, "mit license"])
    rows += [(10, far.replace(" ", "\n")), (11, far), (12, "released under the\nlicense of mine"), (13, None), (14, "")]
    got = {r.doc_id: r for r in licences.scan(frame(rows)).collect()}
    assert {d: got[d].labels for d in WRAPPED} == {d: label for d, (label, _) in WRAPPED.items()}
    assert got[1].score == 1.0 and got[2].score == 1.0
    # Words far apart count on one line, as before, but not over lines.
    assert [got[d].labels for d in (10, 11, 12, 13, 14)] == ["", "mit", "", "", ""]
