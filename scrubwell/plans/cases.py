"""Hand-written cases: a text for every rule, near misses, and what must come of it.

The expected values are written out here, not made from the rule tables, so a
query over them shows what a rule does and not only that two engines agree.
"""

from __future__ import annotations

#: (rule, line or lines before, after)
CLEANING = [
    ("C1", "Stop  !!! now", "Stop. now"), ("C1", "wait!", "wait."), ("C1 near", "no mark here", "no mark here"),
    ("C2", "7 ??????", "7 "), ("C2", "12??????", "12"), ("C2 near", "7 ?????", "7 ?????"), ("C2 near", "x ??????", "x ??????"),
    ("C3", "a\tb\tc", "abc"), ("C3 near", "a b", "a b"),
    ("C4", "???why", "why"), ("C4 near", "why???", "why???"),
    ("C5", "seen by Dr. .... today", "seen by  today"), ("C5", "Dr...", ""), ("C5 near", "Dr. Smith", "Dr. Smith"),
    ("C6", "done.... next", "done. next"), ("C6 near", "3.... next", "3.... next"),
    ("C7", 'he said "... no', 'he said " no'), ("C7 near", 'he said ". no', 'he said ". no'),
    ("C8", "a\n....\nb", "a\nb"), ("C8 near", "a\n.\nb", "a\n.\nb"), ("C8 near", "a\n .. \nb", "a\n .. \nb"),
    ("C9", "a\n ___ \nb", "a\nb"), ("C9 near", "a\n__ __\nb", "a\n__ __\nb"),
    ("C10", "Edema [x] ____", "Edema [x]"), ("C10", "grade ____ high", "grade high"), ("C10 near", "grading ____", "grading ____"),
    ("C11", "Edema a_b__", "Edema ab"), ("C11", "Murmur x___y_ z", "Murmur xy z"), ("C11 near", "edema a_b__", "edema a_b__"),
    ("C12", "last cigarette _____", "last cigarette "), ("C12 near", "last cigarette ____", "last cigarette ____"),
    ("C13", "weight __12__ kg", "weight 12 kg"), ("C13 near", "weight __12 kg", "weight __12 kg"),
    ("C14", "a\n~~~\nb", "a\nb"), ("C14", "a ~~~ b", "a  b"), ("C14 near", "a ~ b", "a ~ b"),
    ("C15", "a\nx @@@ y\nb", "a\nb"), ("C15 near", "a @@ b", "a @@ b"),
    ("all", "Wow !!\n....\n~~\nx\ty ~~ z....", "Wow.\nxy  z."), ("none", "", ""),
]

_D, _R = "[**4-5**]", "4/5"
_before = lambda rule, words: [(rule, f"x {w}{_D} y", f"x {w}{_R} y") for w in words]
_after = lambda rule, words: [(rule, f"x {_D}{w} y", f"x {_R}{w} y") for w in words]
_same = lambda rule, texts: [(rule, t, t) for t in texts]

#: (rule, text before, after the rules that need no map)
DATES = [
    *_before("E1", ["SUNDAY ", "Sunday ", "sunday, ", "MONDAY, ", "Monday", "monday ", "TUESDAY ", "Tuesday,", "tuesday ", "WEDNESDAY ", "Wednesday ", "wednesday  ", "THURDSAY ", "Thursday ", "thursday ", "FRIDAY ", "Friday ", "friday ", "SATURDAY ", "Saturday ", "saturday "]),
    *_same("E1 near", [f"THURSDAY {_D}", f"sunDay {_D}", f"Sunday; {_D}"]),
    *_before("E2", ["bal ", "graph ", "graphy of it ", "xr ", "kub, ", "echo", "ekg ", "eeg ", "ecg ", "tte ", "tee "]),
    *_before("E2", ["BAL ", "GRAPH ", "GRAPHY ", "Culture ", "culture was ", "CSF ", "EGD ", "ECG ", "EEG ", "EKG "]),
    *_before("E2", ["CTAP ", "CT scan ", "CTA ", "CTU ", "MRA ", "MRI ", "MRC ", "MRCP ", "XR ", "PORTABLE chest Film ", "portable", "SPECT ", "PET ", "KUB ", "ECHO ", "US ", "TTE ", "TEE ", "Echo ", "biopsy ", "endoscopy  ", "colectomy "]),
    *_same("E2 near", [f"xr Chest {_D}", f"xr done. {_D}", f"MR {_D}", f"biopsy, {_D}", f"echo\\{_D}"]),
    ("E2 last in reach", f"echo [**1-2**] and {_D}", f"echo [**1-2**] and {_R}"),
    *_after("E3", [" xr", " kub", "  echo", " ecg", " ekg", " tte", " tee", " BAL", " CS", " CSF", " EGD", " EEG", " ECG", " EKG"]),
    *_after("E3", [" blood culture", ", urine Culture", ": angiograph", " CT", " CTA", " CTU", " MRA", " MRI", " MRCP", " XR", " CXR", " film was portable", " PET", " SPECT", " KUB", " ECHO", " US", " TTE", " TEE", " biopsy", " endoscopy", " colectomy"]),
    *_same("E3 near", [f"x {_D}, the urine Culture", f"x {_D} Xr", f"x {_D}xr", f"x {_D}, portable", f"x {_D} bal"]),
    *_before("E4", ["dated ", "Dated ", "on ", "On ", "on the ", "On  the ", "from ", "From ", "since ", "Since ", "through ", "Through ", "thru ", "Thru ", "trough ", "Trough ", "to ", "To ", "until ", "Until "]),
    *_before("E4", ["DATED ", "ON ", "FROM ", "SINCE ", "THROUGH ", "THRU ", "TROUGH ", "TO ", "UNTIL ", "morning of ", "Afternoon of ", "evening  OF ", "Night of ", "MORNING OF ", "AFTERNOON of ", "EVENING OF ", "NIGHT OF "]),
    *_same("E4 near", [f"by {_D}", f"morning {_D}", f"ON THE {_D}", f"on: {_D}"]),
    *_after("E5", [" at 7", "  AT 12"]), *_same("E5 near", [f"x {_D} at noon"]),
    *_before("E6", ["End Date: ", "end date", "END DATE of it ", "Start Date: ", "start date ", "START DATE "]), *_same("E6 near", [f"end date. {_D}", f"start {_D}"]),
    ("E7", f"3/4 and {_D}", f"3/4 and {_R}"), *_same("E7 near", [f"3-4 and {_D}", f"3/4 or {_D}"]),
    ("E8", f"a\n{_D} b", f"a\n{_R} b"), ("E8", f"{_D} b", f"{_R} b"), *_same("E8 near", [f"a\n {_D} b"]),
    ("E9", "in [**2-3**] days", "in 3 days"), ("E9", "in [**1-1**] day", "in 1 day"), ("E9", "in [**10-14**] days", "in 14 days"), *_same("E9 near", ["In [**2-3**] days", "in [**5-6**] days", "in [**2-3**] hours", "in  [**2-3**] days"]),
    ("E10", "in [**2-3**] weeks", "in 3 weeks"), ("E10", "in [**6-8**] weeks", "in 8 weeks"), ("E10", "in [**3-30**] weeks", "in 24 weeks"), *_same("E10 near", ["in [**0-3**] weeks"]),
    ("E11", "in [**1-2**] months", "in 2 months"), ("E11", "in [**3-4**] months", "in 3 months"), ("E11", "in [**6-9**] months", "in 6 months"), ("E11", "in [**8-12**] months", "in 12 months"), *_same("E11 near", ["in [**0-1**] months"]),
    ("E12", "Completed by:[**0-0-0**]", "Completed by:"), *_same("E12 near", ["Completed by: [**0-0-0**]", "by:[**0-0-0**]"]),
    ("E13", "CA [**15**]-9 now", "CA 19-9 now"), *_same("E13 near", ["CA [**15**]-9.", "CA [**1x**]-9 now"]),
    *_same("none", ["", "no placeholder on 4-5", "[**Hospital 5**] on Monday"]),
]

_F = "[**2177-12-5**] "
#: (rule, note before, after its dates are shifted)
BACKDATING = [
    ("R6", "[**2177-12-5**] to [**2192-1-3**]", "12/5/1997 to 1/3/2012"), ("R7", _F + "[**3/2170**] [**-4-/2171**]", "12/5/2017 3/2010 4/2011"), ("R8", _F + "[**2150**] [**1999**]", "12/5/2017 1990 1839"),
    ("R9", _F + "in '[**76**] we", "12/5/2017 in '16 we"), ("R9 near", _F + "in '[**76**]\" we", "12/5/2017 in '[**76**]\" we"), ("R9 near", _F + "in [**76**] we", "12/5/2017 in [**76**] we"), ("R9 near", _F + "'[**76**]", "12/5/2017 '[**76**]"),
    ("R10", _F + "[**263-11-28**] [**2225-1-2**]", "12/5/2017 11/28 1/2"), ("R11", _F + "[**10/2570**] [**1/345**]", "12/5/2017 Oct Jan"), ("R12", _F + "[**5-8**]: x", "12/5/2017 5-8: x"), ("R12 near", _F + "[**5-8**] x", "12/5/2017 [**5-8**] x"),
    ("R5", "[**2177-12-5**] [**2219**]", "12/5/1977 2019"), ("R5", "[**2000-1-1**]", "1/1/2000"),
    ("R4", "only [**10/2570**] and [**2150**]", "only [**10/2570**] and [**2150**]"), ("R4", "[**2220-1-1**]", "[**2220-1-1**]"), ("none", "no date", "no date"),
]

#: (rule, text before, plain training text, anonymised training text)
NORMAL = [
    ("N1", None, "", ""), ("N2", "a\nb\r\nc", "a b c", "a b c"), ("N3", " \t a \n", "a", "a"), ("N4", "ABC", "abc", "abc"), ("N5", "a [x] b [y z]", "a b", "a b"), ("N5 near", "a [x b", "a [x b", "a [x b"),
    ("N6", "1. a 22.b", "a b", "a b"), ("N7", "Dr. A", "doctor a", "doctor a"), ("N8", "A M.D. said", "a md said", "a md said"), ("N8 near", "MD", "md", "md"), ("N9", "a--b __ c == d", "ab c d", "ab c d"), ("N9 near", "a-b", "a-b", "a-b"),
    ("N10", "Admission Date: x Discharge Date: y", "admission date: x discharge date: y", "x y"), ("N11", "aged 77 now", "aged 77 now", "aged now"), ("N12", "a   b", "a b", "a b"),
]

_NAME, _DAY2 = "^[A-Z][a-z]+$", "^[0-9]{2}/[0-9]{2}$"
#: (rule, placeholder, what its surrogate looks like; null: none)
SURROGATES: list[tuple[str, str, str | None]] = [
    ("V1", "[** **]", "^Admission$"), ("V2", "[**Age over 90 3**]", "^(9[0-9]|10[0-9]|11[0-5])$"), ("V3", "[**Attending Info 4**]", "^(Almond|Birch|Cedar|Dogwood|Elm|Fir|Gorse|Hazel)$"), ("V4", "[**CC Contact Info 5**]", "^$"),
    ("V5", "[**Apartment Address(1) 6**]", "^[0-9]{1,3} [A-Z][a-z]+ [A-Z][a-z]+$"), ("V5", "[**Street Address(2) 7**]", "^[0-9]{1,3} [A-Z][a-z]+ [A-Z][a-z]+$"), ("V6", "[**Company 8**]", "Works$|Ltd$|Group$|Mills$"),
    ("V7", "[**Country 9**]", "^(Arvenia|Belmora|Castova|Dorland)$"), ("V8", "[**E-mail address 10**]", "^[a-z]+[0-9]{2}@example[.]org$"), ("V9", "Email: someone", "^Email: [a-z]+[0-9]{2}@example[.]org$"),
    *[("V10", f"[**{x} 11**]", "^(Ada|Bea|Cleo|Dora|Edith|Flora|Greta|Hilda|Iris|June|Kate|Lena|Maud|Nora|Olga|Petra|Abel|Boris|Carl|Dario|Emil|Felix|Gus|Hugo|Ivan|Jonas|Karl|Lars|Milo|Nils|Otto|Paul)$") for x in ("Doctor First Name", "First Name11 (Name Pattern1)", "Known firstname", "Name6 (MD)", "Name10 (NameIs)")],
    *[("V11", f"[**{x} 12**]", "^(Archer|Brook|Carver|Dale|Ellis|Frost|Grove|Hill|Irving|Joyner|Keller|Lowe|Marsh|Noble|Orchard|Parr|Quill|Reed|Stone|Thorn)$") for x in ("Dictator Info", "Doctor Last Name", "Last Name (un)", "Known lastname", "Name (STitle)", "Name5 (PTitle)", "Name7 (MD)", "Name8 (MD)", "Name11 (NameIs)", "Name13 (STitle)", "Name14 (STitle)", "First Name (STitle)")],
    ("V11 near", "[**Name5 (PTitle) **]", None), ("V11 after Dr.", "[**Name (NI) 13**]", _NAME), ("V11 after Dr.", "[**Name2 (NI) 14**]", _NAME), ("V11 near", "[**Name (NI) 15**]", None),
    ("V12", "[**Female First Name (un) 16**]", "^(Ada|Bea|Cleo|Dora|Edith|Flora|Greta|Hilda|Iris|June|Kate|Lena|Maud|Nora|Olga|Petra)$"), ("V13", "[**Male First Name (un) 17**]", "^(Abel|Boris|Carl|Dario|Emil|Felix|Gus|Hugo|Ivan|Jonas|Karl|Lars|Milo|Nils|Otto|Paul)$"),
    ("V14", "[**Name Prefix (Prefixes) 18**]", "^(Mr|Mrs|Ms|Dr)[.]$"), *[("V15", f"[**{x} 19**]", "^[A-Z][.]$") for x in ("Name12 (NameIs)", "Initial (NamePattern1)", "Initials (NamePattern4)")],
    ("V16", "[**Hospital 20**]", "Hospital$|Clinic$|Center$"), ("V16", "[**Hospital3 21**]", "Hospital$|Clinic$|Center$"), ("V17", "[**Location (un) 22**]", _NAME), ("V17 near", "[**Location (un) 23**]", None),
    *[("V18", f"[**{x} 24**]", "^[1-9][0-9]{0,7}$") for x in ("Clip Number (Radiology)", "Job Number", "MD Number(1)", "Medical Record Number", "Serial Number")],
    *[(f"V{18 + k}", f"[**{m} 25**]", f"^{k}/([1-9]|1[0-9]|2[0-8]{extra})$") for k, (m, extra) in enumerate((("January", "|29|30|31"), ("February", ""), ("March", "|29|30|31"), ("April", "|29|30"), ("May", "|29|30|31"), ("June", "|29|30"), ("July", "|29|30|31"), ("August", "|29|30|31"), ("September", "|29|30"), ("October", "|29|30|31"), ("November", "|29|30"), ("December", "|29|30|31")), 1)],
    ("V31", "[**Month (only) 26**]", "^(January|February|March|April|May|June|July|August|September|October|November|December)$"),
    *[("V32", f"[**{x} 27**]", "^(0[1-9]|1[0-2])/(0[1-9]|1[0-9]|2[0-8])$") for x in ("Month/Day (1)", "Month Day", "Day Month", "Month Day Year (2)")], *[("V33", f"[**{x} 28**]", _DAY2) for x in ("Month Year", "Year/Month", "Month/Year (2)", "Day Month Year")],
    *[("V34", f"[**{x} 29**]", "^[0-9]{2}/[0-9]{2}/[0-9]{2}$") for x in ("Month/Day/Year", "Year/Month/Day")], ("V35", "[**Telephone/Fax (1) 30**]", "^555-[0-9]{4}$"), ("V36", "[**PO Box 31**]", "^PO Box [0-9]{1,4}$"),
    ("V37", "[**Social Security Number 32**]", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("V38", "[**Medical record number 33**]", "^[0-9]{1,9}$"), ("V39", "[**State 34**]", "^(Northland|Southmark|Westvale|Eastmoor)$"),
    ("V40", "[**Numeric Identifier 35**]", "^(1?[0-9]{1,3}|2000)$"), ("V40 near", "[**Numeric Identifier 36**]", None), ("V41", "[**University/College 37**]", "^[A-Z][a-z]+ University$"), ("V42", "[**URL 38**]", "^www[.][a-z]+[.]example[.]org$"), ("V43", "[**State/Zipcode 39**]", "^[0-9]{5}$"),
    ("none", "[**Nothing 40**]", None), ("none", "[**2177-12-5**]", None),
]
#: Placeholders of which the words before them decide.
IN_CONTEXT = ["[**Name (NI) 13**]", "[**Name2 (NI) 14**]", "[**Name (NI) 15**]", "[**Location (un) 22**]", "[**Location (un) 23**]", "[**Numeric Identifier 35**]", "[**Numeric Identifier 36**]", "Email: someone"]
#: Notes in which the context keys stand behind their telling words, and others that do not.
CONTEXT = "Email: someone\nsee Dr. [**Name (NI) 13**] or Dr.[**Name2 (NI) 14**], not [**Name (NI) 15**]\nborn - [**Location (un) 22**], not in [**Location (un) 23**]\nUnit No:  [**Numeric Identifier 35**] No: [**Numeric Identifier 36**]"

#: (placeholder whose identifier is #, kind of name placeholder it is, whether a listed pattern asks for the identifier)
KINDS = [
    ("[**Known firstname #**]", "first", True), ("[**Doctor First Name #**]", "first", True), ("[**Female First Name (un) #**]", "first", True), ("[**First Name (STitle) #**]", "first", True), ("[**First Name11 (Name Pattern1) #**]", "first", True),
    ("[**First Name3 (LF) #**]", "first", True), ("[**Male First Name (un) #**]", "first", True), ("[**Name10 (NameIs) #**]", "first", True), ("[**Name6 (MD) #**]", "first", True), ("[**Doctor Last Name #**]", "last", True),
    ("[**Known lastname #**]", "last", True), ("[**Last Name (un) #**]", "last", True), ("[**Last Name #**]", "last", True), ("[**Name11 (NameIs) #**]", "last", True), ("[**Name (STitle) #**]", "last", True), ("[**Name13 (STitle) #**]", "last", True),
    ("[**Name7 (MD) #**]", "last", True), ("[**Name2 (NI) #**]", "last", True), ("[**Name Prefix (Prefixes) #**]", "prefix", True), ("[**Initial (NamePattern1) #**]", "initial", False), ("[**Initials (NamePattern4) #**]", "initial", False),
    ("[**Name Initial (MD) #**]", "initial", False), ("[**Name12 (NameIs) #**]", "initial", False), ("[**Hospital1 #**]", "not_name", True), ("[**Age over 90 #**]", "not_name", True),
]

#: (note, whether no placeholder is left, whether none lacks its identifier)
LEFT = [("replaced", True, True), ("[**Name (STitle) **] or [**x [**State **]", False, False), ("[**State 3**]", False, True), ("[**State 3**] [**Hospital **", False, True), ("Hospital **] and State", True, True), ("a [**Hospital **] b", False, False)]

#: (note, its text once the key "Email: y" has the value x)
WHOLE_LINES = [("Email: y", "x"), ("Email: y\nz", "Email: y\nz"), ("my Email: y", "my Email: y")]
