"""Hand-written signatures of license clauses, notices and file headers, over normalised words.

Each row is (label, keywords of which every match has one, by commas, pattern).  A
signature is a wording that only the license's own text or notice has, so it names the
license without its title.
"""

#: Sentences of the licenses' own texts.
CLAUSES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge"),
    ("mit", "the above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "in no event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the author disclaims all warranties", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", "for any purpose with or without fee", r"for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims"),
    ("hpnd", "without written prior permission,without specific written prior permission", r"not be used in advertising or publicity pertaining to distribution of the software without (?:specific )?written prior permission"),
    ("hpnd", "and that both that copyright notice", r"and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("bsd-3-clause", "the names of its contributors,the names of the contributors", r"the names of (?:its|the) contributors may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", "this product includes software developed by", r"this product includes software developed by the university of california"),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-lbnl", "you are under no obligation", r"you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance"),
    ("bsd-1-clause", "are permitted provided that the following condition", r"are permitted provided that the following condition is met"),
    ("zlib", "as is", r"provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "the origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "this notice may not be removed", r"this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "obtaining a copy of the software and accompanying documentation", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "public domain", r"free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "in jurisdictions that recognize copyright laws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("wtfpl", "you just do what the fuck", r"you just do what the fuck you want to"),
    ("beerware", "can buy me a beer", r"you can buy me a beer in return"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("apache-2.0", "you must cause any modified files", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "see the license for the specific language", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group"),
    ("gpl", "gnu", r"gnu general public license"),
    ("gpl", "free software foundation", r"published by the free software foundation"),
    ("gpl", "this program is free software", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "this program is distributed in the hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "the licenses for most software", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl-2.0", "activities other than copying distribution and modification", r"activities other than copying distribution and modification are not covered by this license"),
    ("gpl-2.0", "accompany it with the complete corresponding machine readable", r"accompany it with the complete corresponding machine readable source code"),
    ("gpl-2.0", "either version 2", r"either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0", "either version 3", r"either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-3.0", "installation information for a user product", r"installation information for a user product means any methods procedures authorization keys"),
    ("gpl-3.0", "to propagate a work", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("gpl-3.0", "protecting users legal rights", r"protecting users legal rights from anti circumvention law"),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", "a work that uses the library", r"a work that uses the library"),
    ("lgpl-3.0", "combined work", r"a combined work is a work produced by combining or linking an application with the library"),
    ("lgpl-2.1", "successor of the gnu library public license", r"the successor of the gnu library public license"),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("fdl", "invariant sections", r"with (?:no|the) invariant sections"),
    ("fdl", "front cover texts", r"with no front cover texts and no back cover texts"),
    ("fdl", "a transparent copy of the document", r"a transparent copy of the document means a machine readable copy"),
    ("mpl-2.0", "this source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "incompatible with secondary licenses", r"incompatible with secondary licenses"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-1.1", "the initial developer of the original code", r"the initial developer of the original code is"),
    ("epl", "the accompanying program is provided", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl", "the accompanying program is provided", r"the accompanying program is provided under the terms of this common public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "covered software is provided", r"covered software is provided under this license on an as is basis"),
    ("eupl", "european union public,licensed under the eupl", r"licensed under the eupl|european union public licen[cs]e v 1 [012]"),
    ("osl", "licensed under the open software license", r"licensed under the open software license version [123] \d"),
    ("afl", "licensed under the academic free license", r"licensed under the academic free license version [123] \d"),
    ("artistic", "the copyright holder maintains some semblance", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic", "everyone is permitted to copy and distribute verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("perl", "under the same terms as perl itself", r"under the same terms as perl itself"),
    ("python", "beopen com", r"beopen com license agreement for python"),
    ("psf", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "this product includes php", r"this product includes php software"),
    ("openssl", "openssl toolkit", r"for use in the openssl toolkit"),
    ("openssl", "written by eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", "use copy modify and distribute this software", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice|license)"),
    ("ofl", "reserved font name", r"with reserved font name"),
    ("ofl", "the fonts and derivatives", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("icu", "unicode data files", r"unicode data files or unicode software"),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    ("libpng", "the contributing authors and glenn", r"the contributing authors and glenn randers pehrson"),
    ("freetype", "freetype", r"portions of this software are copyright (?:\S+ )?the freetype project"),
    ("postgresql", "the university of california", r"in no event shall the university of california be liable to any party for direct indirect special"),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction including without limitation"),
    ("upl", "larger works", r"larger works to which the software is contributed"),
    ("busl-1.1", "additional use grant", r"additional use grant"),
    ("busl-1.1", "make non production use", r"make non production use of the licensed work"),
    ("elastic-2.0", "as a hosted or managed service", r"provide the software to third parties as a hosted or managed service"),
    ("sspl", "service source code", r"make the service source code available"),
    ("commons-clause", "commons clause", r"commons clause license condition"),
    ("commons-clause", "does not grant to you the right to sell", r"the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|small business|strict|perimeter) license"),
    ("json", "shall be used for good", r"the software shall be used for good not evil"),
    ("mulan", "mulan psl", r"you can use this software according to the terms and conditions of the mulan psl"),
    ("odbl", "open database license", r"(?:made available under the )?open database license"),
    ("odc-by", "open data commons", r"open data commons (?:attribution|by)(?: license)?"),
    ("pddl", "public domain dedication and license", r"public domain dedication and license"),
    ("public-domain", "public domain", r"(?:released into|placed in|dedicated to|in) the public domain"),
    ("public-domain", "no rights reserved", r"no rights reserved"),
    ("cc0", "affirmer hereby", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0", "has waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", "you must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "you may not use the material for commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", "distribute your contributions under the same license", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "you may not distribute the modified material", r"you may not distribute the modified material"),
    ("cc", "creative commons", r"creative commons(?: \S+){0,4} licen[cs]e"),
    ("cc", "some rights reserved", r"some rights reserved"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "unpublished proprietary", r"this is unpublished proprietary source code"),
    ("proprietary", "end user license agreement", r"end user license agreement"),
    ("proprietary", "reverse engineer", r"you may not (?:modify )?reverse engineer decompile or disassemble"),
    ("proprietary", "no part of this", r"no part of this (?:publication|work|document|book) may be reproduced"),
    ("proprietary", "trade secrets of", r"contains trade secrets of"),
)

#: Addresses that notices point to, as normalised words.
ADDRESSES = (
    ("apache-2.0", "apache org", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-1.1", "apache org", r"(?:https? )?(?:www )?apache org licenses license 1 1"),
    ("cc", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses [a-z]+(?: [a-z]{2})*(?: \d 0)?"),
    ("cc0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain", r"creativecommons org publicdomain mark 1 0"),
    ("bsl-1.0", "boost org", r"(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("mpl-2.0", "mozilla org", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org", r"(?:https? )?(?:www )?mozilla org mpl (?:mpl )?1 1"),
    ("gpl", "gnu org", r"(?:https? )?(?:www )?gnu org licenses(?: gpl)?(?: [23] 0)?"),
    ("lgpl", "gnu org licenses lgpl", r"gnu org licenses lgpl(?: [23] [01])?"),
    ("agpl", "gnu org licenses agpl", r"gnu org licenses agpl(?: 3 0)?"),
    ("fdl", "gnu org licenses fdl", r"gnu org licenses fdl(?: 1 [123])?"),
    ("epl", "eclipse org legal", r"eclipse org legal epl (?:v10|2 0|v20)"),
    ("mit", "opensource org licenses", r"opensource org licenses mit(?: license php)?"),
    ("bsd", "opensource org licenses", r"opensource org licenses bsd (?:license|[23] clause)"),
    ("isc", "opensource org licenses", r"opensource org licenses isc"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("wtfpl", "wtfpl net", r"(?:www )?wtfpl net"),
    ("zlib", "zlib net", r"zlib net zlib license"),
    ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?"),
    ("cddl", "opensolaris org os licensing", r"opensolaris org os licensing"),
    ("psf", "docs python org", r"docs python org (?:3 )?license"),
    ("php", "php net license", r"(?:www )?php net license"),
    ("ruby", "ruby lang org", r"(?:www )?ruby lang org en about license"),
    ("vim", "vimdoc sourceforge net", r"vimdoc sourceforge net htmldoc uganda"),
    ("eupl", "joinup ec europa eu", r"joinup ec europa eu (?:\S+ ){0,4}eupl"),
)
