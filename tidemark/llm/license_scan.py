"""Licence scan by ordered signature rules, in DataFrame functions only.

A rule is a licence's name in one way of citing it, or a sentence or address that only its text holds; the order of
the ways is their priority. A document first meets a prefilter of plain words without blanks: every match of every
rule holds one of them. Where one stands, white space and the comment signs within it are folded to one blank, for
names may be wrapped over lines, and each rule whose own keywords all stand there runs over the whole text. Matches
are intervals of that text. One that lies inside an interval of the same or a higher priority is suppressed; what
stays gives the labels and the score.

The base phrases are counted apart, over words, and their labels always stay.

Defined results: a null text counts as empty. A document without words has n_words 0 and a score of 0. Rows are scanned
one by one, repeated rows and null ids too. Python's only part is to write the expressions down.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, keyword that every match holds, and the name over folded lower-case text.
FULL_NAMES = [
    ("mit", "mit", r"mit(?:[- ]style)?[- ]licen[sc]e"),
    ("mit", "x11", r"(?:mit/x11|x11)(?: licen[sc]e)?"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit", "massachusetts institute", r"massachusetts institute of technology licen[sc]e"),
    ("apache", "apache", r"apache(?: software| public)? licen[sc]e"),
    ("apache", "apache", r"apache[- ]?v?(?:ersion )?[12](?:\.[01])?(?: software)? licen[sc]e"),
    ("apache", "apache-", r"apache-(?:1\.[01]|2\.0)"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:[- ]?v?[123](?:\.0)?)?(?:-only|-or-later|\+)?(?: licen[sc]e)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lesser gpl", r"(?:gnu )?lesser gpl(?: licen[sc]e)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:[- ]?v?[23](?:\.[01])?)?(?:-only|-or-later|\+)?(?: licen[sc]e)?"),
    ("agpl", "affero", r"(?:gnu )?affero (?:general public licen[sc]e|gpl)"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?:[- ]?v?3(?:\.0)?)?(?:-only|-or-later|\+)?(?: licen[sc]e)?"),
    ("bsd", "bsd", r"(?:(?:new|modified|revised|simplified|original|free) )?bsd(?:[- ]style)?[- ]licen[sc]e"),
    ("bsd", "bsd", r"bsd[- ](?:zero|two|three|four|[0234])[- ]clause(?:[- ]licen[sc]e)?"),
    ("bsd", "bsd", r"(?:zero|two|three|four|[0234])[- ]clause bsd(?:[- ]licen[sc]e)?"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e"),
    ("mpl", "mpl-", r"mpl-[12]\.[01]"),
    ("epl", "eclipse", r"eclipse (?:public|distribution) licen[sc]e"),
    ("epl", "epl-", r"epl-[12]\.0"),
    ("cc", "creative commons", r"creative commons(?: (?:attribution|noncommercial|non-commercial|sharealike|share-alike|noderivatives|noderivs))?(?:[- ](?:noncommercial|non-commercial|sharealike|share-alike|noderivatives|noderivs))*(?: (?:public )?licen[sc]e)?"),
    ("cc", "cc-by", r"cc-by(?:-(?:nc|sa|nd))*(?:-[1-4]\.[05])?"),
    ("cc", "cc by-", r"cc by(?:-(?:nc|sa|nd))+(?: [1-4]\.[05])?"),
    ("cc0", "cc0", r"cc0(?:[- ]1\.0)?(?: universal)?"),
    ("cc0", "commons zero", r"creative commons zero"),
    ("isc", "isc licen", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("libpng", "libpng licen", r"(?<!zlib/)libpng licen[sc]e"),
    ("boost", "boost software", r"boost software licen[sc]e"),
    ("boost", "bsl-1.0", r"bsl-1\.0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("artistic", "artistic licen", r"(?:perl )?artistic licen[sc]e"),
    ("artistic", "artistic-", r"artistic-[12]\.0"),
    ("psf", "python software", r"python software foundation licen[sc]e"),
    ("psf", "psf-2.0", r"psf-2\.0"),
    ("cddl", "common development", r"common development and distribution licen[sc]e"),
    ("cddl", "cddl", r"cddl(?:[- ]?v?1\.[01])?"),
    ("wtfpl", "do what the", r"do what the [a-z*]+ you want to public licen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("eupl", "european union public", r"european union public licen[sc]e"),
    ("eupl", "eupl", r"eupl(?:[- ]?v?1\.[0-2])?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-pl", "ms-pl", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e"),
    ("ofl", "ofl-1", r"ofl-1\.[01]"),
    ("odbl", "open database", r"open database licen[sc]e"),
    ("odbl", "odbl", r"odbl(?:-1\.0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("gfdl", "gfdl", r"gfdl(?:[- ]?v?1\.[1-3])?"),
    ("public-domain", "public domain", r"public domain"),
    ("afl", "academic free", r"academic free licen[sc]e"),
    ("osl", "open software licen", r"open software licen[sc]e"),
    ("cpl", "common public licen", r"common public licen[sc]e"),
    ("cpal", "common public attribution", r"common public attribution licen[sc]e"),
    ("ipl", "ibm public", r"ibm public licen[sc]e"),
    ("qpl", "q public", r"q public licen[sc]e"),
    ("sspl", "server side public", r"server side public licen[sc]e"),
    ("busl", "business source", r"business source licen[sc]e"),
    ("elastic", "elastic licen", r"elastic licen[sc]e"),
    ("ogl", "open government", r"open government licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e"),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e"),
    ("openssl", "openssl licen", r"openssl licen[sc]e"),
    ("php", "php licen", r"php licen[sc]e"),
    ("ruby", "ruby licen", r"ruby licen[sc]e"),
    ("vim", "vim licen", r"vim licen[sc]e"),
    ("json", "json licen", r"json licen[sc]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("sleepycat", "sleepycat licen", r"sleepycat licen[sc]e"),
    ("proprietary", "rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:licen[sc]e|and confidential)"),
    ("proprietary", "commercial licen", r"commercial licen[sc]e"),
]

#: Names that are words of other meanings too, and count only where they are cited.
SHORT_NAMES = [
    ("mit", "mit", r"mit"),
    ("apache", "apache", r"apache(?:[- ]?v?(?:ersion )?[12](?:\.[01])?)?"),
    ("bsd", "bsd", r"bsd"),
    ("mpl", "mpl", r"mpl(?:[- ]?v?[12](?:\.[01])?)?"),
    ("epl", "epl", r"epl(?:[- ]?v?[12](?:\.0)?)?"),
    ("cc", "cc by", r"cc by(?: [1-4]\.[05])?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib"),
    ("boost", "boost", r"boost"),
    ("artistic", "artistic", r"artistic"),
    ("psf", "psf", r"psf"),
    ("ofl", "ofl", r"ofl"),
    ("unlicense", "unlicensed", r"unlicensed"),
    ("ncsa", "ncsa", r"ncsa"),
]

#: Sentences and addresses that stand for a licence: label, keyword, expression.
SIGNATURES = [
    ("mit", "hereby granted, free of charge, to any person obtaining", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("boost", "hereby granted, free of charge, to any person or", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms,? with or without modification"),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("gpl", "redistribute it and/or modify it under", r"redistribute it and/or modify it under the terms of (?:version 2 of )?the gnu general public licen[sc]e"),
    ("lgpl", "redistribute it and/or modify it under", r"redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "redistribute it and/or modify it under", r"redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("apache", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e"),
    ("mpl", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl", "accompanying materials are made available under", r"accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "without any express or implied warranty", r"this software is provided ['\"]?as-is['\"]?,? without any express or implied warranty\. in no event will the authors be held liable"),
    ("ofl", "font software is licensed under", r"this font software is licensed under the sil open font licen[sc]e"),
    ("cc0", "waived all copyright", r"to the extent possible under law, .{1,120}? has waived all copyright"),
    ("mit", "opensource.org/licenses/mit", r"opensource\.org/licenses/mit"),
    ("bsd", "opensource.org/licenses/bsd", r"opensource\.org/licenses/bsd(?:-[0-9]-clause|-license)?"),
    ("isc", "opensource.org/licenses/isc", r"opensource\.org/licenses/isc"),
    ("apache", "apache.org/licenses/license", r"apache\.org/licenses/license-(?:1\.[01]|2\.0)"),
    ("gpl", "gnu.org/licenses/", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", "gnu.org/licenses/", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", "gnu.org/licenses/", r"gnu\.org/licenses/(?:old-licenses/)?fdl"),
    ("mpl", "mozilla.org/mpl", r"mozilla\.org/mpl"),
    ("epl", "eclipse.org/legal/epl", r"eclipse\.org/legal/epl"),
    ("cc", "creativecommons.org/licenses/by", r"creativecommons\.org/licenses/by(?:-(?:nc|sa|nd))*"),
    ("cc0", "creativecommons.org/publicdomain/zero", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "creativecommons.org/publicdomain/mark", r"creativecommons\.org/publicdomain/mark"),
    ("boost", "boost.org/license", r"boost\.org/license"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("ofl", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
]

#: Forms of package manifests, badges, comments and other languages, each written as it stands there: label,
#: keyword, expression. The German word "mit" is no licence, so that language's form wants a hyphen.
FORMS = [
    ("mit", "license :: osi approved :: mit", r"license :: osi approved :: mit (?:no attribution )?license"),
    ("apache", "license :: osi approved :: apache", r"license :: osi approved :: apache software license"),
    ("bsd", "license :: osi approved :: bsd", r"license :: osi approved :: bsd license"),
    ("gpl", "license :: osi approved :: gnu general", r"license :: osi approved :: gnu general public license(?: v[23](?: or later)? \(gplv[23]\+?\)| \(gpl\))?"),
    ("lgpl", "license :: osi approved :: gnu l", r"license :: osi approved :: gnu (?:lesser|library or lesser) general public license(?: v[23](?: or later)? \(lgplv[23]\+?\)| \(lgpl\))?"),
    ("agpl", "license :: osi approved :: gnu affero", r"license :: osi approved :: gnu affero general public license v3(?: or later)?(?: \(agplv3\+?\))?"),
    ("mpl", "license :: osi approved :: mozilla", r"license :: osi approved :: mozilla public license(?: [12]\.[01] \(mpl(?: [12]\.[01])?\))?"),
    ("isc", "license :: osi approved :: isc", r"license :: osi approved :: isc license \(iscl\)"),
    ("psf", "license :: osi approved :: python", r"license :: osi approved :: python software foundation license"),
    ("zlib", "license :: osi approved :: zlib", r"license :: osi approved :: zlib/libpng license"),
    ("epl", "license :: osi approved :: eclipse", r"license :: osi approved :: eclipse public license [12]\.0 \(epl-[12]\.0\)"),
    ("eupl", "license :: osi approved :: european", r"license :: osi approved :: european union public licence 1\.[012] \(eupl 1\.[012]\)"),
    ("boost", "license :: osi approved :: boost", r"license :: osi approved :: boost software license 1\.0 \(bsl-1\.0\)"),
    ("unlicense", "license :: osi approved :: the unlicense", r"license :: osi approved :: the unlicense \(unlicense\)"),
    ("artistic", "license :: osi approved :: artistic", r"license :: osi approved :: artistic license"),
    ("cc0", "license :: cc0", r"license :: cc0 1\.0 universal \(cc0 1\.0\) public domain dedication"),
    ("public-domain", "license :: public domain", r"license :: public domain"),
    ("proprietary", "license :: other/proprietary", r"license :: other/proprietary license"),
    ("gpl", "module_license", r"module_license ?\( ?\"gpl(?: v2)?(?: and additional rights)?\""),
    ("bsd", "module_license", r"module_license ?\( ?\"dual bsd"),
    ("mit", "module_license", r"module_license ?\( ?\"dual mit"),
    ("mpl", "module_license", r"module_license ?\( ?\"dual mpl"),
    ("proprietary", "module_license", r"module_license ?\( ?\"proprietary"),
    ("mit", "licenses.mit", r"licenses\.mit"),
    ("apache", "licenses.asl20", r"licenses\.asl20"),
    ("bsd", "licenses.bsd", r"licenses\.bsd(?:[023]|original)"),
    ("gpl", "licenses.gpl", r"licenses\.gpl[123](?:plus|only)?"),
    ("lgpl", "licenses.lgpl", r"licenses\.lgpl(?:2|21|3)(?:plus|only)?"),
    ("agpl", "licenses.agpl", r"licenses\.agpl3(?:plus|only)?"),
    ("mpl", "licenses.mpl", r"licenses\.mpl(?:10|11|20)"),
    ("isc", "licenses.isc", r"licenses\.isc"),
    ("zlib", "licenses.zlib", r"licenses\.zlib"),
    ("boost", "licenses.boost", r"licenses\.boost"),
    ("epl", "licenses.epl", r"licenses\.epl[12]0"),
    ("cc0", "licenses.cc0", r"licenses\.cc0"),
    ("artistic", "licenses.artistic", r"licenses\.artistic[12]"),
    ("psf", "licenses.psfl", r"licenses\.psfl"),
    ("ofl", "licenses.ofl", r"licenses\.ofl"),
    ("public-domain", "licenses.publicdomain", r"licenses\.publicdomain"),
    ("proprietary", "licenses.unfree", r"licenses\.unfree(?:redistributable)?"),
    ("bsd", "license: bsd", r"license: bsd[234]"),
    ("public-domain", "license: publicdomain", r"license: publicdomain"),
    ("proprietary", "license: allrights", r"license: allrightsreserved"),
    ("artistic", "licen", r"licen[sc]e[\"']? ?(?:=>|:|=) ?[\"']?perl(?:_5)?"),
    ("mit", "badge/licen", r"badge/licen[sc]e-mit"),
    ("apache", "badge/licen", r"badge/licen[sc]e-apache(?:(?:%20|_|--)?v?2(?:\.0)?)?"),
    ("bsd", "badge/licen", r"badge/licen[sc]e-bsd(?:(?:%20|_|--)[0-4](?:(?:%20|_|--)clause)?)?"),
    ("gpl", "badge/licen", r"badge/licen[sc]e-gpl(?:(?:%20|_|--)?v?[23](?:\.0)?)?"),
    ("lgpl", "badge/licen", r"badge/licen[sc]e-lgpl(?:(?:%20|_|--)?v?[23](?:\.[01])?)?"),
    ("agpl", "badge/licen", r"badge/licen[sc]e-agpl(?:(?:%20|_|--)?v?3(?:\.0)?)?"),
    ("mpl", "badge/licen", r"badge/licen[sc]e-mpl(?:(?:%20|_|--)?v?[12](?:\.[01])?)?"),
    ("epl", "badge/licen", r"badge/licen[sc]e-epl(?:(?:%20|_|--)?v?[12](?:\.0)?)?"),
    ("isc", "badge/licen", r"badge/licen[sc]e-isc"),
    ("cc", "badge/licen", r"badge/licen[sc]e-cc(?:%20|_|--)by(?:(?:%20|_|--)(?:nc|sa|nd))*"),
    ("cc0", "badge/licen", r"badge/licen[sc]e-cc0"),
    ("unlicense", "badge/licen", r"badge/licen[sc]e-unlicense"),
    ("proprietary", "badge/licen", r"badge/licen[sc]e-proprietary"),
    ("mit", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?(?:mit|expat|x11)"),
    ("apache", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?(?:apache|asl)"),
    ("bsd", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?(?:(?:new|revised|simplified|[23][- ]clause) )?bsd"),
    ("gpl", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?(?:gnu )?gpl(?:[- ]?v?[123](?:\.0)?)?"),
    ("lgpl", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?(?:gnu )?lgpl(?:[- ]?v?[23](?:\.[01])?)?"),
    ("agpl", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?(?:gnu )?agpl(?:[- ]?v?3(?:\.0)?)?"),
    ("mpl", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?mpl(?:[- ]?v?[12](?:\.[01])?)?"),
    ("epl", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?epl(?:[- ]?v?[12](?:\.0)?)?"),
    ("isc", "<licen", r"<licen[sc]e(?: type=\"expression\")?> ?(?:<name> ?)?(?:the )?isc"),
    ("proprietary", "<licen", r"<licen[sc]e> ?(?:<name> ?)?(?:proprietary|commercial|closed[- ]source)"),
    ("mit", "license_family", r"license_family ?: ?mit"),
    ("apache", "license_family", r"license_family ?: ?apache"),
    ("bsd", "license_family", r"license_family ?: ?bsd"),
    ("gpl", "license_family", r"license_family ?: ?gpl[23]?"),
    ("lgpl", "license_family", r"license_family ?: ?lgpl"),
    ("agpl", "license_family", r"license_family ?: ?agpl"),
    ("mpl", "license_family", r"license_family ?: ?mozilla"),
    ("cc", "license_family", r"license_family ?: ?cc"),
    ("public-domain", "license_family", r"license_family ?: ?public[-_]domain"),
    ("proprietary", "license_family", r"license_family ?: ?proprietary"),
    ("mit", "@licen", r"@licen[sc]e:? (?:the )?mit"),
    ("apache", "@licen", r"@licen[sc]e:? (?:the )?apache"),
    ("bsd", "@licen", r"@licen[sc]e:? (?:the )?(?:new )?bsd"),
    ("isc", "@licen", r"@licen[sc]e:? (?:the )?isc"),
    ("zlib", "@licen", r"@licen[sc]e:? (?:the )?zlib"),
    ("boost", "@licen", r"@licen[sc]e:? (?:the )?boost"),
    ("mit", "license ", r"license :?[\"']mit[\"']"),
    ("isc", "license ", r"license :?[\"']isc[\"']"),
    ("zlib", "license ", r"license :?[\"']zlib[\"']"),
    ("ncsa", "license ", r"license :?[\"']ncsa[\"']"),
    ("mit", "{licenses", r"\{licenses, ?\[ ?[\"']mit"),
    ("apache", "{licenses", r"\{licenses, ?\[ ?[\"']apache"),
    ("bsd", "{licenses", r"\{licenses, ?\[ ?[\"']bsd"),
    ("isc", "{licenses", r"\{licenses, ?\[ ?[\"']isc"),
    ("mit", "apache-2.0", r"apache-2\.0(?: or |/)mit"),
    ("mit", "licence mit", r"licence mit"),
    ("apache", "licence apache", r"licence apache(?:[- ]v?(?:ersion )?[12](?:\.[01])?)?"),
    ("bsd", "licence bsd", r"licence bsd(?: modifi[éÉ]e| simplifi[éÉ]e)?"),
    ("isc", "licence isc", r"licence isc"),
    ("gpl", "licence publique", r"licence publique g[éÉ]n[éÉ]rale(?: gnu)?"),
    ("lgpl", "licence publique", r"licence publique g[éÉ]n[éÉ]rale (?:limit[éÉ]e|amoindrie)(?: gnu)?"),
    ("mpl", "licence publique mozilla", r"licence publique mozilla"),
    ("epl", "licence publique eclipse", r"licence publique eclipse"),
    ("cc", "licence creative", r"licence creative[- ]commons"),
    ("public-domain", "domaine public", r"domaine public"),
    ("proprietary", "tous droits", r"tous droits r[éÉ]serv[éÉ]s"),
    ("proprietary", "licence propri", r"licence propri[éÉ]taire"),
    ("mit", "mit-lizenz", r"mit-lizenz"),
    ("apache", "apache-", r"apache-(?:2\.0-)?lizenz"),
    ("bsd", "bsd-", r"bsd-(?:[0234]-(?:klausel|clause)-)?lizenz"),
    ("gpl", "gpl-lizenz", r"(?:gnu-)?gpl-lizenz"),
    ("gpl", "gnu-lizenz", r"allgemeinen? [öÖ]ffentlichen? gnu-lizenz"),
    ("cc", "creative-commons-lizenz", r"creative-commons-lizenz"),
    ("public-domain", "gemeinfrei", r"gemeinfrei(?:e[mnrs]?)?"),
    ("proprietary", "rechte vorbehalten", r"alle rechte vorbehalten"),
    ("mit", "licencia mit", r"licencia mit"),
    ("apache", "licencia ", r"licencia (?:p[úÚ]blica )?apache"),
    ("bsd", "licencia bsd", r"licencia bsd"),
    ("isc", "licencia isc", r"licencia isc"),
    ("gpl", "licencia p", r"licencia p[úÚ]blica general(?: (?:de )?gnu)?"),
    ("lgpl", "licencia p", r"licencia p[úÚ]blica general (?:reducida|menor)(?: (?:de )?gnu)?"),
    ("mpl", "licencia p", r"licencia p[úÚ]blica de mozilla"),
    ("cc", "licencia creative", r"licencia creative[- ]commons"),
    ("public-domain", "dominio p", r"dominio p[úÚ]blico"),
    ("proprietary", "derechos reservados", r"todos los derechos reservados"),
]


VERSION = r"(?:,? \(?v(?:ersion|\.)? ?[0-9]+(?:\.[0-9]+)*\)?)"

#: What stands before the second and later names of an SPDX expression.
SPDX_BEFORE = r"(?<=spdx-license-identifier: ?[a-z0-9.+() -]{1,100} (?:or|and|with) ?\(?)"

#: Ways of citing, most telling first: keywords beside the name's, expression, confidence, and whether a
#: short name may stand there. {n} is the name, {v} a version.
CITATIONS = [
    (("spdx-license-identifier:",), r"spdx-license-identifier: ?\(*{n}", 1.0, True),
    (("under ",), r"(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|shared) (?:only )?under (?:the )?(?:terms? (?:and conditions )?of )?(?:either )?(?:the |an? )?{n}{v}?(?: or (?:\(at your option\) )?(?:any )?later(?: version)?)?", 0.95, True),
    (("spdx-license-identifier:",), SPDX_BEFORE + "{n}", 0.95, True),
    (("subject to ",), r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}{v}?", 0.9, True),
    (("licen",), r"licen[sc](?:e|es|ing)[\"']? ?(?:=>|[:=]) ?[\[({]? ?(?:[\"':]?(?:text|type|name|id|value)[\"']? ?(?:=>|[:=]) ?)?[\"'(]?(?:the )?{n}", 0.85, True),
    (("copying",), r"copying[\"']? ?[:=] ?[\"'(]?(?:the )?{n}", 0.85, True),
    (("licensed",), r"{n}[- ]licensed", 0.85, True),
    ((), r"{n}{v}", 0.8, False),
    ((), r"{n}", 0.5, False),
]


class Rule(NamedTuple):
    priority: int
    label: str
    keywords: tuple[str, ...]  # all of them stand in every match, the name's own first
    pattern: str
    sure: float


def rules() -> list[Rule]:
    """In order of priority; signatures of a text stand beside the citations of the second kind, forms beside keys."""
    made = [Rule(p, label, (key, *words, *["licen"] * name.endswith("licen[sc]e")), way.replace("{n}", f"(?:{name})").replace("{v}", VERSION), sure) for p, (words, way, sure, short) in enumerate(CITATIONS) for label, key, name in FULL_NAMES + SHORT_NAMES * short]
    return sorted([*made, *[Rule(1, label, (key,), pattern, 0.95) for label, key, pattern in SIGNATURES], *[Rule(4, label, (key,), pattern, 0.85) for label, key, pattern in FORMS]], key=lambda r: (r.priority, r.label))


#: The prefilter, words without blanks. Every rule has a keyword that holds one of them (a test sees to it).
PREFILTER = [
    "licen", "under", "subject", "copying", "gpl", "bsd", "x11", "apache-", "mpl-", "epl-", "bsl-", "psf-", "ofl-", "artistic-", "cc0", "cc-by", "by-", "commons", "cddl", "wtfpl", "eupl",
    "ms-pl", "odbl", "gfdl", "domain", "reserved", "proprietary", "hereby", "redistribut", "permission", "required", "unencumbered", "warranty", "waived", "org/mpl", "legal/epl", "org/ofl", "affero",
    "lizenz", "gemeinfrei", "vorbehalten", "droits", "dominio", "derechos",
]

#: White space between words, of a line or across lines, with the comment signs in it; possessive, so long runs are safe.
SPACE = r"[\s\u0085\u00A0\u2000-\u200B\u2028\u2029\u202F\u205F\u3000]"
SIGN = rf"(?:[#*;%!>|]+/?|/[/*]+!?|--+>?|<!--+|(?:dnl|rem)(?={SPACE}))"
GAP = f"(?:{SPACE}++{SIGN}?+)++"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` is much quicker, changes other letters too, which here are all alike, and makes ASCII
    letters of two signs alone."""
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), exact).otherwise(F.lower(text))


def _any(found: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, found)


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, " ", ""))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def base_phrases(rows: DataFrame) -> DataFrame:
    """rows with words: " w0 w1 ... ". Adds n_base, first_word, last_word, base_set."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        at = F.instr(F.col("words"), f" {phrase} ")
        back = F.instr(F.reverse(F.col("words")), f" {phrase[::-1]} ")
        first, rest = phrase.split(" ", 1)
        counts.append(F.regexp_count(F.col("words"), F.lit(f" {first}(?= {rest} )")))
        firsts.append(F.when(at > 0, _spaces(F.substring(F.col("words"), F.lit(1), at - 1))))
        behind = _spaces(F.substring(F.reverse(F.col("words")), F.lit(1), back - 1))
        lasts.append(F.when(back > 0, F.col("n_words") - behind - len(phrase.split(" "))))
        labels.append(F.when(at > 0, F.lit(label)))
    return rows.withColumns({"n_base": F.coalesce(_total(counts), F.lit(0)).cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"), "base_set": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))})


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r.priority, r.label, r.keywords[0], list(r.keywords), r"(?<![a-z0-9])" + r.pattern + r"(?![a-z0-9])", r.sure) for i, r in enumerate(rules())], "rule int, priority int, label string, keyword string, keywords array<string>, pattern string, sure double")


def intervals(gated: DataFrame) -> DataFrame:
    """gated: row, low. (row, priority, label, sure, begin, end) of every rule's matches; places are characters."""
    keywords = F.array(*[F.lit(k) for k in sorted({r.keywords[0] for r in rules()})])
    families = gated.select("row", "low", F.explode(F.filter(keywords, lambda k: F.contains(F.col("low"), k))).alias("keyword"))
    # The rules are a fixed table of some hundreds of rows; few of them have all their keywords in a document.
    tried = families.join(F.broadcast(rule_table(gated.sparkSession)), "keyword").where("forall(keywords, k -> contains(low, k))").where("regexp_like(low, pattern)")
    # Matches cut the text into the pieces between them; running sums of both give the places.
    n, gap = F.expr("transform(regexp_extract_all(low, pattern, 0), x -> char_length(x))"), F.expr("transform(split(low, pattern, -1), x -> char_length(x))")
    cut = tried.select("row", "rule", "priority", "label", "sure", n.alias("n"), gap.alias("gap"))
    cut = cut.select("row", "rule", "priority", "label", "sure", F.posexplode(F.arrays_zip("n", "gap")).alias("i", "step")).where("step.n is not null")
    so_far = Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("step.n") + F.col("step.gap")).over(so_far)
    return cut.withColumn("end", end).select("row", "priority", "label", "sure", (F.col("end") - F.col("step.n")).alias("begin"), "end")


def surviving(intervals: DataFrame) -> DataFrame:
    """Drops an interval that lies within one of the same or a higher priority (of equal ones, the first label stays)."""
    order = Window.partitionBy("row").orderBy("begin", F.desc("end"), "priority", "label").rowsBetween(Window.unboundedPreceding, -1)
    cover = {f"c{p}": F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order) for p in range(len(CITATIONS))}
    covered = reduce(lambda a, p: F.when(F.col("priority") == p, F.col(f"c{p}")).otherwise(a), range(len(CITATIONS)), F.lit(None))
    return intervals.withColumns(cover).where(F.coalesce(covered < F.col("end"), F.lit(True))).select(*intervals.columns)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    rows = rows.withColumn("n_words", F.array_size(F.array_remove(F.split("low", NOT_WORD), "")).cast("long"))
    rows = rows.withColumn("words", F.when(F.contains("low", F.lit("license")), F.concat(F.lit(" "), F.btrim(F.regexp_replace("low", NOT_WORD, " ")), F.lit(" "))))
    prefilter = _any([F.contains("low", F.lit(w)) for w in PREFILTER])
    rows = base_phrases(rows).withColumn("low", F.when(prefilter, F.regexp_replace("low", GAP, " "))).drop("words")
    rows = stored(rows, "scanned")  # only the texts that run rules are kept
    kept = surviving(intervals(rows.where("low is not null").select("row", "low")))
    found = kept.groupBy("row").agg(F.collect_set("label").alias("method"), F.max("sure").alias("sure"))
    out = rows.drop("low").join(found, "row", "left")
    both = F.array_sort(F.array_distinct(F.concat("base_set", F.coalesce("method", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))
