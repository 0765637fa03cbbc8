"""License scan by ordered signature rules, in DataFrame expressions only.

Texts are lower-cased (A-Z) and cut into words; each word is written between single spaces, so that a rule's words
stand as `` w1  w2 `` and a rule is a plain regular expression over whole words.  There are two kinds of rules:
sentences of license texts, grants, notices and exceptions (``SIGNATURES``), and wordings of reference and identifier
(``TEMPLATES``) around the names of each license (``NAMES``).  A rule runs only on texts that hold one of its keywords,
and texts without any keyword skip the whole step.

A detection is the interval of words of one match.  It is suppressed if another detection of higher priority, or of
the same priority and longer, contains it.  A sweep over the detections in order of start keeps the largest end for
each priority, so the cost grows with the detections and not with their square.

Everything happens within a row: there is no shuffle, no Python and no join.  Null texts are empty; they have no
words and no labels.  Repeated rows are scanned each; extra columns are not read, whatever their names.  A very long
text is scanned whole, in time that grows with its length (a pass for each rule whose keyword it holds).  Of two
detections of one interval and priority, the one whose label sorts first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases of the contract, label by phrase.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# License names as their words appear after cutting, by label.
NAMES = {
    "mit": ["mit", "expat", "mit expat"],
    "apache-2.0": ["apache license version 2( 0)?", "apache license 2( 0)?", "apache 2 0", "apache software license( version)? 2 0", "asl 2 0"],
    "apache-1.1": ["apache software license( version)? 1 1", "apache 1 1"],
    "gpl-3.0": ["gnu general public license( version)? 3", "gnu gpl( version)? 3", "gpl v3", "gplv3", "gpl 3 0"],
    "gpl-2.0": ["gnu general public license( version)? 2", "gnu gpl( version)? 2", "gpl v2", "gplv2", "gpl 2 0"],
    "lgpl-3.0": ["gnu lesser general public license( version)? 3", "lgpl v3", "lgplv3", "lgpl 3 0"],
    "lgpl-2.1": ["gnu lesser general public license( version)? 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"],
    "agpl-3.0": ["gnu affero general public license( version)? 3", "agpl v3", "agplv3", "agpl 3 0"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "bsd-4-clause": ["bsd 4 clause", "4 clause bsd", "original bsd"],
    "0bsd": ["0bsd", "zero clause bsd"],
    "mpl-2.0": ["mozilla public license( version)? 2( 0)?", "mpl 2 0"],
    "mpl-1.1": ["mozilla public license( version)? 1 1", "mpl 1 1"],
    "epl-2.0": ["eclipse public license( version)? 2( 0)?", "epl 2 0"],
    "epl-1.0": ["eclipse public license( version)? 1( 0)?", "epl 1 0"],
    "cddl-1.0": ["common development and distribution license( version)?( 1 0)?", "cddl 1 0"],
    "isc": ["isc", "internet systems consortium"],
    "zlib": ["zlib", "zlib libpng"],
    "boost-1.0": ["boost software license( version)?( 1 0)?", "bsl 1 0"],
    "artistic-2.0": ["artistic license( version)? 2( 0)?", "artistic 2 0"],
    "unlicense": ["the unlicense", "unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "cc0-1.0": ["cc0( 1 0)?", "creative commons zero", "creative commons cc0"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivs"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivs", "creative commons attribution noderivatives"],
    "python-2.0": ["python software foundation", "psf"],
    "openssl": ["openssl"],
    "ofl-1.1": ["sil open font license( version)?( 1 1)?", "ofl 1 1"],
    "eupl-1.2": ["european union public licen[cs]e( v)?( 1 2)?", "eupl 1 2"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "odbl-1.0": ["open database license( version)?( 1 0)?", "odbl 1 0"],
    "proprietary": ["proprietary"],
    "commercial": ["commercial"],
}
#: Sentences that mark a license, by hand: priority, label, keywords (one of which is in every match) and words; (..)? is optional.
SIGNATURES = """
6 mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software
5 mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
5 mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions
5 mit-no-attribution | mit | mit no attribution|mit 0
4 x11 | consortium | the name of the x consortium shall not be used in advertising
4 warranty-disclaimer | warranty | the software is provided as is without warranty of any kind
4 warranty-disclaimer | merchantability | (including but not limited to )?(the )?(implied )?warranties of merchantability( and)? fitness for a particular purpose
4 warranty-disclaimer | liable | in no event shall the (authors or copyright holders|copyright holders?( or contributors)?|authors?) be liable
4 warranty-disclaimer | warranty | this program comes with absolutely no warranty
4 warranty-disclaimer | warranty | without any warranty without even the implied warranty
6 apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
5 apache-2.0 | compliance | you may not use this file except in compliance with the license
5 apache-2.0 | apache | you may obtain a copy of the license at http(s)? www apache org licenses license 2 0
4 apache-2.0 | apache | apache org licenses license 2 0
4 apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free
3 patent-grant | patent | (grant of )?patent license|patent grant
6 bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?
5 bsd | redistributions | redistributions of source code must retain the above copyright notice
5 bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
6 bsd-3-clause | endorse | neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
5 bsd-3-clause | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
6 bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
5 bsd-2-clause-patent | bsd | bsd 2 clause plus patent
5 bsd-protection | bsd | bsd protection license
6 0bsd | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
6 isc | permission | is hereby granted provided that the above copyright notice and this permission notice appear in all copies
4 gpl | gnu | gnu general public license
5 gpl | redistribute | (this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license
6 gpl-2.0-or-later | foundation | as published by the free software foundation either version 2 of the license or (at your option )?any later version
6 gpl-3.0-or-later | foundation | as published by the free software foundation either version 3 of the license or (at your option )?any later version
5 gpl-2.0-only | gpl,gplv2 | gpl 2 0 only|gplv2 only|gpl v2 only
5 gpl-2.0-or-later | gpl,gplv2 | gpl 2 0 or later|gplv2 or later|gpl v2 or later|gpl version 2 or later
5 gpl-3.0-only | gpl,gplv3 | gpl 3 0 only|gplv3 only|gpl v3 only
5 gpl-3.0-or-later | gpl,gplv3 | gpl 3 0 or later|gplv3 or later|gpl v3 or later|gpl version 3 or later
5 lgpl-2.1-or-later | lgpl,lgplv2 | lgpl 2 1 or later|lgplv2 1 or later
5 lgpl-3.0-or-later | lgpl,lgplv3 | lgpl 3 0 or later|lgplv3 or later
5 agpl-3.0-or-later | agpl,agplv3 | agpl 3 0 or later|agplv3 or later
4 gpl | gnu | you should have received a copy of the gnu general public license along with this program
4 lgpl | lesser | you should have received a copy of the gnu lesser general public license
4 agpl | affero | you should have received a copy of the gnu affero general public license
4 gpl | gnu | gnu org licenses gpl( 2 0| 3 0)?( html)?
4 lgpl | gnu | gnu org licenses lgpl( 2 1| 3 0)?( html)?
4 agpl | gnu | gnu org licenses agpl( 3 0)?( html)?
4 lgpl | lesser | gnu lesser general public license
4 lgpl | gnu | gnu library general public license
4 agpl | affero | gnu affero general public license
3 gpl | gpl | the gpl|gpl licensed|gpl compatible|gnu gpl
3 lgpl | lgpl | the lgpl|lgpl licensed
3 agpl | agpl | the agpl|agpl licensed
5 gfdl | gnu | gnu free documentation license( version)?( 1 [123])?
4 gfdl | fdl,gfdl | gnu fdl|gfdl( 1 [123])?
5 gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
6 classpath-exception | classpath | classpath exception( 2 0)?
5 classpath-exception | exception | as a special exception the copyright holders of this library give you permission to link
5 gcc-exception | gcc | gcc runtime library exception( 3 1)?
5 llvm-exception | llvm | (apache 2 0 )?with llvm exceptions?|llvm exception
5 linking-exception | exception | special exception to the gnu general public license|linking exception
5 font-exception | font | font exception( 2 0)?|embedding this font (in|into) a document
5 bison-exception | bison | bison exception( 2 2)?
5 autoconf-exception | autoconf | autoconf exception( [23] 0)?
5 openssl-exception | openssl | permission to link (the code of )?(this program|portions of this program) with the openssl library
6 mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license (v 2|v2) 0
5 mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
4 mpl-2.0 | mozilla | mozilla org mpl 2 0|mozilla org en us mpl 2 0
3 mpl | mozilla | mozilla public licen[cs]e
5 epl-2.0 | eclipse | eclipse org legal epl (v20|v2 0|2 0)
5 epl-1.0 | eclipse | eclipse org legal epl (v10|v1 0|1 0)
5 epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
3 epl | eclipse | eclipse public licen[cs]e
4 edl-1.0 | eclipse | eclipse distribution license( v)?( 1 0)?
5 cddl-1.0 | license | subject to the terms of the common development and distribution license
5 cddl-1.1 | cddl | cddl( version)? 1 1
5 gpl-cddl-dual | cddl | dual licensed? under (the )?cddl and (the )?gpl
5 cpl-1.0 | license | common public license( version)?( 1 0)?
5 ipl-1.0 | ibm | ibm public license( version)?( 1 0)?
5 apsl-2.0 | apple | apple public source license( version)?( 2 0)?
5 spl-1.0 | license | sun public license( version)?( 1 0)?
5 npl | netscape | netscape public license( version)?( 1 [01])?
5 qpl-1.0 | license | q public license( version)?( 1 0)?
5 nokia | nokia | nokia open source license
5 intel | intel | intel open source license
5 ncsa | illinois | university of illinois( ncsa)? open source license
5 ncsa | ncsa | ncsa open source license
5 w3c | w3c | w3c software( and document)?( notice and)? license
5 unicode | unicode | unicode license agreement( data files and software)?|unicode terms of use
5 icu | icu | icu license
5 php-3.01 | php | php license( version)?( 3 01)?
5 ruby | ruby | ruby license|same (license|terms) as ruby
5 perl | perl | same terms as perl( itself)?
4 artistic | artistic | the artistic license|artistic license
5 artistic-1.0 | artistic | artistic license( version)? 1 0
5 lppl-1.3c | latex | latex project public license( version)?( 1 3c?)?
5 tcl | tcl | tcl tk license|tcl license
5 vim | vim,charityware | vim license|charityware
5 curl | curl | curl license
5 libpng | libpng,png | libpng license( version)?( 2 0)?|png reference library license
6 zlib | arising | in no event will the authors be held liable for any damages arising from the use of this software
5 zlib | misrepresented | the origin of this software must not be misrepresented
5 zlib | altered | altered source versions must be plainly marked as such
5 boost-1.0 | boost | boost org license 1 0( txt)?
5 boost-1.0 | boost | distributed under the boost software license( version 1 0)?
6 unlicense | unencumbered | this is free and unencumbered software released into the public domain
5 unlicense | unlicense | for more information please refer to http(s)? unlicense org
4 public-domain | domain | (dedicated|released|placed|put)( in| into| to) the public domain
4 public-domain | domain | (is|are) in the public domain
3 public-domain | domain | public domain( dedication| mark)?
5 cc0-1.0 | waived | to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights
5 cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
5 cc-pdm | creativecommons | creativecommons org publicdomain mark 1 0
5 cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
5 cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
5 cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
5 cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
5 cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
5 cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
4 cc-by-sa | sa | cc by sa [1-4] [05]( international| unported)?
4 cc-by-nc | nc | cc by nc [1-4] [05]( international| unported)?
4 cc-by-nc-sa | nc | cc by nc sa [1-4] [05]( international| unported)?
4 cc-by-nc-nd | nc | cc by nc nd [1-4] [05]( international| unported)?
4 cc-by-nd | nd | cc by nd [1-4] [05]( international| unported)?
4 cc-by | cc | cc by [1-4] [05]( international| unported)?
5 cc-by-sa | creative | creative commons attribution (share alike|sharealike) [1-4] [05]( international| unported| generic)?
5 cc-by-nc | creative | creative commons attribution (non commercial|noncommercial) [1-4] [05]( international| unported| generic)?
5 cc-by-nc-sa | creative | creative commons attribution (non commercial|noncommercial) (share alike|sharealike) [1-4] [05]( international| unported| generic)?
5 cc-by-nc-nd | creative | creative commons attribution (non commercial|noncommercial) (no derivatives|noderivatives|noderivs|no derivs) [1-4] [05]( international| unported| generic)?
5 cc-by | creative | creative commons attribution [1-4] [05]( international| unported| generic)?
3 creative-commons | creative | creative commons( licen[cs]e(s|d)?)?
5 odbl-1.0 | opendatacommons | opendatacommons org licenses odbl( 1 0)?
5 odc-by-1.0 | attribution,odc | open data commons attribution licen[cs]e( v)?( 1 0)?|odc by( 1 0)?
5 pddl-1.0 | pddl,dedication | pddl( 1 0)?|open data commons public domain dedication
5 ogl-3.0 | government | open government licen[cs]e( v3 0| 3 0| v 3 0)?
5 ofl-1.1 | font | this font software is licensed under the sil open font license( version 1 1)?
5 ofl-1.1 | reserved | with reserved font name
4 ofl-1.1 | scripts | scripts sil org ofl
5 wtfpl | fuck | do what the fuck you want to( public license)?
5 beerware | beer,beerware | the beer ware license|beerware license|you can buy me a beer in return
5 jsonlicense | evil | the software shall be used for good not evil
5 hippocratic | hippocratic | hippocratic license( version)?( [23] [01])?
5 rail | rail,openrail,responsible | rail( m)? license|openrail( m)? license|responsible ai licen[cs]es?
5 openrail | bigscience | bigscience (rail|openrail)( m)?( license)?
5 sspl-1.0 | license | server side public license( version)?( v1| v 1| 1)?
5 busl-1.1 | license | business source license( version)?( 1 1)?
5 elastic-2.0 | elastic | elastic license( version)?( v| v2| 2)?( 0)?
5 commons-clause | commons | commons clause( license condition)?( v)?( 1 0)?
5 polyform | polyform | polyform (noncommercial|small business|shield|strict|perimeter)( license)?( 1 0 0)?
5 confluent | confluent | confluent community license( agreement)?( version)?( 1 0)?
5 timescale | timescale | timescale license( agreement)?
5 cecill-2.1 | cecill | cecill( free software license agreement)?( v)?( 2 1)?|cecill [abc]( 1 0)?
5 mulan-psl-2.0 | mulan | mulan (psl|permissive software license)( v2| v 2| 2)?
5 upl-1.0 | permissive | universal permissive license( version)?( v)?( 1 0)?
5 afl-3.0 | academic | academic free license( version)?( v3 0| v 3 0| 3 0)?
5 osl-3.0 | license | open software license( version)?( v3 0| v 3 0| 3 0)?
5 cpal-1.0 | attribution | common public attribution license( version)?( 1 0)?
5 rpl-1.5 | reciprocal | reciprocal public license( version)?( 1 5)?
5 ms-rl | reciprocal,rl | microsoft reciprocal license|ms rl
5 ms-lpl | microsoft | microsoft limited public license
5 ecl-2.0 | educational | educational community license( version)?( 2 0)?
5 naist-2003 | nara | nara institute of science and technology
5 python-2.0 | psf,python | psf license agreement( for python)?|python software foundation license( version)?( 2)?
5 openssl | openssl | this product includes software developed by the openssl project
5 ssleay | young | this product includes cryptographic software written by eric young
5 sleepycat | sleepycat | sleepycat (public )?license|the sleepycat license
5 postgresql | postgresql | postgresql licen[cs]e
5 imagemagick | imagemagick | imagemagick license
5 ijg | jpeg | this software is based in part on the work of the independent jpeg group
5 freetype | freetype | freetype (project )?license
5 bitstream-vera | vera | bitstream vera (fonts? )?(copyright|license)
4 dual-license | dual | dual licensed?( under)?
4 dual-license | either | at your (choice|option) under either
4 dual-license | either | licensed under either of
4 proprietary | reserved | all rights reserved
4 proprietary | confidential,proprietary | (this|the) (software|document|material) is (the )?(confidential|proprietary)( and proprietary)?( information)?
4 proprietary | reproduction | unauthori[sz]ed (reproduction|copying|distribution)
4 proprietary | prohibited | (is|are) strictly prohibited
4 proprietary | agreement,eula | end user licen[cs]e agreement|eula
4 non-commercial | commercial | (for )?non commercial (use|purposes?)( only)?
4 non-commercial | noncommercial | (for )?noncommercial (use|purposes?)( only)?
4 no-derivatives | derivatives,derivative | no derivatives|no derivative works
4 share-alike | alike | share alike
4 evaluation | evaluation | (for )?evaluation (use|purposes?) only
4 research-only | research | (for )?research (use|purposes?) only|non commercial research
3 spdx | spdx | spdx license identifier|spdx filecopyrighttext
3 license-notice | license | see (the )?license( file)?( for( more)? (details|information))?
3 license-notice | license | (this|the) license (applies|governs|grants)
3 license-notice | licensed | licensed to .{1,60} under one or more contributor license agreements
3 license-notice | copying | see (the )?(file )?copying( file)?( for( more)? details)?
"""
#: Priority and wording of each rule around the names of a license; (..)? is optional.
TEMPLATES = (
    (5, "spdx license identifier {}"),
    (4, "(licensed|released|distributed|available|published|provided) under( the)?( terms of)?( the)? {}( license| licence)?"),
    (3, "under( the)?( terms of)?( the)? {}( license| licence)?"),
    (2, "{} (license|licence)"),
)
#: Names that mean a license even without one of the wordings.
BARE = (1, "{}")
WORD_LIKE = ("mit", "expat", "isc", "psf", "proprietary", "commercial", "openssl", "zlib", "freebsd", "mit expat")
PRIORITIES = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: SQL of what stands before a match in marked text; it is a separator, so it is no word.
MARK = "chr(1)"

#: Words one of which stands in every name.
KEYWORDS = (
    "mit expat apache asl gnu gpl gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 bsd 0bsd freebsd mozilla mpl eclipse epl cddl distribution isc consortium zlib boost bsl "
    "artistic unlicense wtfpl fuck cc0 cc creative psf python openssl sil ofl european eupl microsoft ms database odbl proprietary commercial"
).split()


def _spaced(phrase: str) -> str:
    """The expression of a phrase over spaced words: between the words of every alternative stand two spaces."""
    text, depth, parts = "", 0, []
    for c in phrase:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(text)
            text = ""
        else:
            text += c
    doubled = [x.replace(" ", "  ") for x in (*parts, text)]
    return f" ({'|'.join(doubled)}) " if parts else f" {doubled[0]} "


def rules() -> list[dict]:
    """label, priority, keywords and expression of each rule, in order; every match holds a keyword."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        first, keyword, phrase = line.split(" | ", 2)
        priority, label = first.split(" ")
        out.append({"label": label, "priority": int(priority), "keywords": tuple(keyword.split(",")), "regex": _spaced(phrase)})
    for label, names in NAMES.items():
        for bare, templates in ((False, TEMPLATES), (True, (BARE,))):
            own = [n for n in names if not (bare and n in WORD_LIKE)]
            keywords = tuple(dict.fromkeys(next(w for w in n.split("(")[0].split() if w in KEYWORDS) for n in own))
            named = own[0] if len(own) == 1 else f"({'|'.join(own)})"
            out += [{"label": label, "priority": priority, "keywords": keywords, "regex": _spaced(template.format(named))} for priority, template in templates if own]
    return out


def _n_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def _matches(rule: dict) -> str:
    """SQL: detections of one rule in ``spaced``.  A mark is put before every match, so that all starts come from one pass over the words."""
    regex = f"'{rule['regex']}'"
    places = f"filter(transform(split(trim(regexp_replace(spaced, {regex}, concat(' ', {MARK}, ' $0'))), '  '), (w, i) -> if(w = {MARK}, i, null)), i -> i is not null)"
    n_words = "(length(z.`1`) - length(replace(z.`1`, ' ', ''))) div 2"
    # a start is a place less the marks before it
    one = f"named_struct('start', z.`0` - i, 'minus_stop', cast(i - z.`0` - {n_words} as int), 'minus_priority', -{rule['priority']}, 'label', '{rule['label']}')"
    return f"case when rlike(spaced, {regex}) then transform(arrays_zip({places}, regexp_extract_all(spaced, {regex}, 0)), (z, i) -> {one}) end"


def detections() -> Column:
    """array<struct<start, minus_stop, minus_priority, label>> of all rule matches in ``spaced``, by start and longest first; word numbers from 0.

    ``held`` are the keywords of the text.  One SQL expression: it is parsed at once, where hundreds of columns would each cost calls.
    """
    by_keywords: dict[tuple, list[str]] = {}
    for rule in rules():
        by_keywords.setdefault(rule["keywords"], []).append(_matches(rule))
    gated = [f"case when arrays_overlap(held, array({', '.join(map(repr, keywords))})) then flatten(array_compact(array({', '.join(found)}))) end" for keywords, found in by_keywords.items()]
    return F.expr(f"array_sort(flatten(array_compact(array({', '.join(gated)}))))")


def surviving(found: Column) -> Column:
    """struct<labels, priority>: labels of the detections that none contains, and the highest priority among them."""
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).alias("priority"), F.array_repeat(F.lit(-1), PRIORITIES).alias("ends"))

    def step(state: Column, d: Column) -> Column:
        stop, priority = -d["minus_stop"], -d["minus_priority"]
        covered = F.array_max(F.slice(state["ends"], priority, F.lit(PRIORITIES))) >= stop
        ends = F.transform(state["ends"], lambda e, i: F.when(i + 1 == priority, F.greatest(e, stop)).otherwise(e))
        kept = F.struct(F.array_union(state["labels"], F.array(d["label"])).alias("labels"), F.greatest(state["priority"], priority).alias("priority"), ends.alias("ends"))
        return F.when(covered, state).otherwise(kept)

    return F.aggregate(found, start, step)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    known = F.array(*map(F.lit, sorted({k for r in rules() for k in r["keywords"]})))
    rows = docs.select("doc_id", words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", known).alias("held"), "words")
    rows = rows.select("doc_id", "n_words", "held", F.when(F.size("held") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).alias("spaced"))
    pieces = [F.split("spaced", _spaced(phrase)) for phrase, _ in BASE]
    held = [F.when(F.col("spaced").isNull(), 0).otherwise(F.size(p) - 1) for p in pieces]
    first = [F.when(h > 0, _n_words(p[0])) for h, p in zip(held, pieces, strict=True)]
    last = [F.when(h > 0, F.col("n_words") - _n_words(F.element_at(p, -1)) - len(phrase.split())) for h, p, (phrase, _) in zip(held, pieces, BASE, strict=True)]
    base = F.array_sort(F.array_compact(F.array(*(F.when(h > 0, label) for h, (_, label) in zip(held, BASE, strict=True)))))
    kept = F.when(F.col("spaced").isNotNull(), surviving(detections()))
    rows = rows.select("doc_id", "n_words", kept.alias("kept"), sum(held[1:], held[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"), base.alias("base"))
    labels = F.array_sort(F.array_union("base", F.coalesce("kept.labels", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 0.8).otherwise(0.0), F.coalesce(F.col("kept.priority") / PRIORITIES, F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"))


def oracle_sql() -> str:
    """The same scan in DuckDB, over the same rules."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(r['label'])}, {r['priority']}, [{', '.join(quoted(f' {k} ') for k in r['keywords'])}], {quoted(r['regex'])})" for r in rules())
    n_words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    summed = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: {n_words('y')})), 0)"
    base = "".join(f", regexp_split_to_array(spaced, {quoted(_spaced(phrase))}) AS p{i}" for i, (phrase, _) in enumerate(BASE))
    n = range(len(BASE))
    return f"""
        WITH rules(label, priority, keywords, regex) AS (VALUES {listed}),
        low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
        cut AS (SELECT r, doc_id, low, regexp_replace(concat(' ', regexp_replace(low, '{SEPARATORS}', '  ', 'g'), ' '), '^ +| +$', ' ', 'g') AS spaced FROM low),
        found AS (SELECT r, label, priority, regexp_extract_all(spaced, regex) AS m, regexp_split_to_array(spaced, regex) AS p FROM cut, rules WHERE len(list_filter(keywords, lambda k: contains(spaced, k))) > 0 AND regexp_matches(spaced, regex)),
        placed AS (SELECT r, label, priority, m, p, unnest(range(1, len(m) + 1)) AS i FROM found),
        started AS (SELECT r, label, priority, {summed("p[1:i]")} + {summed("m[1:i-1]")} AS start, {n_words("m[i]")} AS n FROM placed),
        det AS (SELECT r, label, priority, start, start + n AS stop FROM started),
        kept AS (SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM det g WHERE g.r = d.r AND g.priority >= d.priority AND g.stop >= d.stop AND (g.start, -g.stop, -g.priority, g.label) < (d.start, -d.stop, -d.priority, d.label))),
        method AS (SELECT r, list(DISTINCT label) AS labels, max(priority) AS priority FROM kept GROUP BY r),
        pieces AS (SELECT *{base} FROM cut),
        counted AS (SELECT *, {", ".join(f"len(p{i}) - 1 AS h{i}" for i in n)} FROM pieces),
        based AS (SELECT r, doc_id, low, {" + ".join(f"h{i}" for i in n)} AS n_base,
            least({", ".join(f"CASE WHEN h{i} > 0 THEN {n_words(f'p{i}[1]')} END" for i in n)}) AS first_word,
            greatest({", ".join(f"CASE WHEN h{i} > 0 THEN {n_words('spaced')} - {n_words(f'p{i}[-1]')} - {len(BASE[i][0].split())} END" for i in n)}) AS last_word,
            list_filter([{", ".join(f"CASE WHEN h{i} > 0 THEN {quoted(BASE[i][1])} END" for i in n)}], lambda x: x IS NOT NULL) AS base FROM counted)
        SELECT doc_id, len(regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS n_words, n_base, first_word, last_word,
            coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ','), '') AS labels,
            greatest(CASE WHEN n_base > 0 THEN 0.8::DOUBLE ELSE 0::DOUBLE END, coalesce(priority / {PRIORITIES}.0, 0)::DOUBLE) AS score
        FROM based LEFT JOIN method USING (r)"""
