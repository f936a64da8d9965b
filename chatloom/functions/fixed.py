"""Lists, tables and patterns that decide results."""

# ---- fixed values: lexical search -----------------------------------------
STOP_WORDS = tuple(
    "a an the and that this with from into have has had was were are am can did does will "
    "shall may might must for but not never neither nor you your they them their she her him "
    "his its our out about just then than there here what when where who how why would could "
    "should been being also very more most some any all to of in on at as by or if it is be do "
    "we he me my up no so us during between through within without among around".split()
)
IRREGULAR_NEGATIVES = {"ca": "can", "wo": "will", "sha": "shall", "ai": "am"}
CJK_CLASS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
SUFFIX_RULES = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("aliti", "al"),
    ("iviti", "ive"), ("ements?", ""), ("ments?", ""), ("ances?", ""), ("ences?", ""),
    ("ness", ""), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("al", ""),
    ("e", ""), ("s", ""),
)
MIN_STEM = 4
STEM_WEIGHT = 0.35

# field -> (weight, length weight)
BM25_FIELDS = {
    "identity": (0.8, 0.2),
    "anchor": (0.45, 0.2),
    "heading": (2.2, 0.3),
    "body": (1.0, 0.75),
}
BM25_K1 = 1.2
BM25_MIN_LENGTH_NORM = 0.1
RRF_OFFSET = 20
RRF_SCALE = 1000.0

# ---- fixed values: ledger and grouping -------------------------------------
EXTRACTION_VERSION = 57
STABILITY_BUFFER = 2
L1_GROUP_SIZE, L1_GROUP_MIN, L1_GROUP_MAX = 8, 2, 50
L2_GROUP_SIZE, L2_GROUP_MIN, L2_GROUP_MAX = 24, 4, 200
L3_GROUP_SIZE, L3_START = 6, 12
CHECKPOINT_INTERVAL, CHECKPOINT_KEEP = 32, 12
STORY_POLICY_VERSION = 2
DEFAULT_USER_NAME, DEFAULT_OTHER_NAME = "User", "Character"

# ---- fixed values: record dedupe -------------------------------------------
PLURAL_EXCEPTIONS = r"(?:ss|sith)$"
RECORD_STOP_WORDS = tuple(
    "about after again also and are because been being but current currently does from had has "
    "have into not now still that the their them then there they this through was were what when "
    "where which while with without".split()
)
RECORD_EQUIVALENTS = {
    "concealed": "conceal", "concealing": "conceal", "hidden": "conceal", "hiding": "conceal",
    "recognized": "identify", "recognizes": "identify", "recognizing": "identify",
    "identity": "identify",
    "released": "unrestrain", "releases": "unrestrain", "releasing": "unrestrain",
    "removed": "unrestrain", "removes": "unrestrain", "removing": "unrestrain",
    "unbound": "unrestrain", "unclips": "unrestrain", "unclipped": "unrestrain",
    "restraint": "unrestrain", "restrained": "unrestrain",
}
ENTITY_STOP_WORDS = tuple(
    "about and controlled controls from into its mobile private secret the this with".split()
)
GROUP_NAME_TOKENS = ("group", "team", "unit", "party", "squad", "character", "person", "people")
STATE_ATTRIBUTES = {
    "current location": "location", "physical location": "location", "whereabouts": "location",
    "current activity": "activity", "current objective": "objective", "current plan": "plan",
    "immediate plan": "plan", "afternoon plan": "plan",
}

# ---- fixed values: narrative time ------------------------------------------
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
SEASON_MONTH = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}
DAY_PARTS = (
    ("dawn", 360), ("morning", 540), ("noon", 720), ("afternoon", 900), ("evening", 1080),
    ("night", 1200),
)
TIME_RELATIONS = ("same-period", "after", "before", "overlaps", "detached", "unknown")
TIME_CERTAINTIES = ("explicit", "implicit", "unknown")
MAIN_FRAME = "main narrative"
QUANTITY = r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|several|a few)"
TIME_UNIT = (
    r"(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?|mornings?|afternoons?|"
    r"evenings?|nights?)"
)
RELATIVE_TIME = (
    rf"\b(?:right now|now|currently|today|tonight|yesterday|tomorrow|later|earlier|recently|soon|"
    rf"this\s+{TIME_UNIT}|that\s+{TIME_UNIT}|"
    rf"(?:last|next|previous|following|past)\s+(?:{QUANTITY}\s+)?{TIME_UNIT}|"
    rf"in\s+{QUANTITY}\s+{TIME_UNIT}|{QUANTITY}\s+{TIME_UNIT}\s+(?:ago|later|earlier)|"
    rf"(?:the\s+)?(?:day|night|week|month|year)\s+(?:before|after))\b"
)
UNKNOWN_TIME_SOURCE = "its recorded past source; exact anchor unavailable"

# ---- fixed values: enums -----------------------------------------------------
ENUMS = {
    "persistence": (("temporary", "recurring", "persistent"), "temporary"),
    "scope": (("scene", "ongoing"), "scene"),
    "operation": (("set", "clear"), "set"),
    "thread_status": (("open", "resolved", "abandoned"), "open"),
    "background_status": (("active", "resolved", "dormant"), "active"),
    "certainty": (("confirmed", "reported", "rumored", "uncertain"), "uncertain"),
}
DEFAULT_IMPORTANCE = 3
RECORD_CATEGORIES = (
    "entities", "facts", "states", "relationships", "events", "threads", "backgrounds",
    "l1", "l2", "l3",
)

# ---- fixed values: audit and merge patterns -----------------------------------
KNOWLEDGE_GAP = r"(?i)\b(?:does not know|doesn't know|did not know|didn't know|has not learned|hasn't learned|was not told|wasn't told|has not been told|hasn't been told|is unaware|remains unaware|no knowledge of)\b"
KNOWLEDGE_RETRACTED = r"(?i)\b(?:no longer|mistaken|wrong|retracted|disproved)\b"
KNOWLEDGE_ESTABLISHED = r"(?i)\b(?:knows?|aware|has learned|learned|discovers?|discovered|recognizes?|recognized|identifies?|identified|confirms?|confirmed|understands?|understood|remembers?|remembered|recalls?|recalled)\b"
KNOWLEDGE_UNSURE = r"(?i)\b(?:suspects?|believes?|thinks?|may|might|possibly|perhaps|unverified|without (?:proof|evidence))\b"
IDENTITY_DESCRIPTION = r"(?i)\b(?:alias|appearance|apprentice|background|commander|council|formerly?|habit|identity|investigator|Jedi|master|member|mentor|Padawan|personality|quirk|rank|role|served|Sith|student|teacher|title|trained)\b"
STRUCTURED_PROFILE = r"(?i)\b(?:Role/background|Age/demographics|Appearance|Personality/quirks):"
DESCRIPTION_STOP_WORDS = (
    "about", "after", "also", "and", "are", "been", "being", "but", "current", "currently", "for", "former",
    "formerly", "from", "had", "has", "have", "her", "hers", "him", "his", "into", "now", "she", "that",
    "the", "their", "them", "they", "this", "was", "were", "who", "with", "without", "years",
)
IDENTITY_ROLE_TOKENS = (
    "master", "mentor", "teacher", "captain", "commander", "leader", "handler", "apprentice", "student",
    "padawan", "pupil", "parent", "mother", "father", "brother", "sister", "sibling", "spouse", "husband",
    "wife", "attendant", "retainer", "servant", "guardian", "ward",
)
ADDRESS_CATEGORY = r"^forms? of address$"
ADDRESS_PREFIXES = ("calls ", "form of address for ")
ADDRESS_USE = r"^(?:uses?|used) (?:a )?(?:(?:respectful|formal|informal|honorific|familiar|derisive|disrespectful) )?(?:address|address form|form of address|nickname) (?:toward|towards|for|with) "
ADDRESS_PLACEHOLDER = r"(?i)(?:\[\s*(?:canonical\s+)?(?:speaker|addressee)(?:\s+unavailable)?\s*\]|canonical\s+addressee|actual[_\s-]+canonical[_\s-]+name)"
ADDRESS_ABSENCE = r"(?i)^(?:\[\s*)?(?:addressee\s+)?(?:unavailable|not established|none|n/a|no (?:direct )?address(?: is)? established)(?:\s*\])?$"
ADDRESS_BRACKET = r"[\[\]]"
ADDRESS_PRONOUN = r"(?i)^(?:i|me|my|mine|myself|you|your|yours|yourself|yourselves|he|him|his|himself|she|her|hers|herself|it|its|itself|we|us|our|ours|ourselves|they|them|their|theirs|themself|themselves)$"
NOT_ASSERTED = r"(?i)\b(?:asks?|asked|questions?|questioned|wonders?|wondered)\s+(?:whether|if)\b"
FUTURE_COMMITMENT = r"(?i)\b(?:i|we)(?:\s+[\p{L}\p{N}'’-]+){0,4}?\s*(?:['’]ll|\b(?:will|shall|am going to|are going to)\b)\s+([^.!?\n]{2,220})"
FUTURE_ANCHOR = r"(?i)\b(?:tomorrow|later|next\s+(?:day|morning|afternoon|evening|night|week|month|year)|eventually|after(?:ward|wards)?|after\s+|before\s+|once\s+|when\s+|upon\s+|in\s+(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:minute|hour|day|week|month|year)s?)\b"
RESTRAINED = r"(?i)\b(?:restrained|bound|cuffed|handcuffed|shackled|chained|tied)\b"
RESTRAINT_RELEASED = r"(?i)\b(?:removes?|removed|unclips?|unclipped|unlocks?|unlocked|releases?|released|frees?|freed|unfastens?|unfastened|cuts? off|cut off)\b"
RESTRAINT_ENDED = r"(?i)\bno longer\s+(?:restrained|bound|cuffed|handcuffed|shackled|chained|tied)\b"
POSSESSION_ATTRIBUTE = r"(?i)\b(?:possession|possesses|inventory|ownership|carrying|carries|holds|equipment)\b"
IMMUTABLE_IDENTITY = r"(?i)\b(?:species|race|birthplace|birth place|date of birth|parentage|biological parent|true identity|real identity)\b"
ROLE_IDENTITY = r"(?i)\b(?:rank|role|position|title|office|designation)\b"
TEMPORAL_TRANSITION = r"(?i)\b(?:former|previous|prior|now|currently|became|becomes|promoted|demoted|appointed|retired|replaced|succeeded)\b"
THREAD_GAP = r"(?i)\b(?:not yet|never (?:told|learned|knew|disclosed|answered|explained|revealed|identified|confirmed|established)|has not|have not|had not|does not|do not|did not|is not|are not|was not|were not|continues? to|seek(?:s|ing)? to (?:determine|learn|discover|identify|find|decide|understand)|tr(?:y|ies|ied|ying) to (?:determine|learn|discover|identify|find|decide|understand)|unknown|unanswered|unresolved|undecided|pending|unconfirmed|incomplete|incoming|en route|on the way|on standby|ready (?:for|to)|prepared (?:for|to)|not (?:complete|completed|done|confirmed|established|disclosed|answered|accepted|met|delivered)|no (?:(?:clear|definitive|final|verified)\s+)?(?:answer|decision|confirmation|evidence|proof)|no (?:confirmed|verified|established|identified|known)\b[^.!?;]{0,100}\b(?:identified|confirmed|verified|established|found|determined|known)|neither\b[^.!?;]{0,160}\b(?:complete|completed|done|obtained|recovered)|lacks? (?:confirmation|evidence|proof|an answer)|awaits?|must (?:learn|discover|identify|find|decide|preserve|maintain|continue|keep)|still (?:required|needed|missing|pending|unresolved|unconfirmed)|remains? (?:unknown|unanswered|unresolved|undecided|missing|pending|unconfirmed|incomplete|open|hidden|concealed|undisclosed))\b"
THREAD_COMMITMENT = r"(?i)\b(?:must|will|shall|['’]ll|going to|plans? to|intends? to|promises? to|vows? to|prepar(?:e|es|ed|ing) to|en route|in transit|heading to|on (?:the )?way to|arrival (?:is )?expected|tomorrow|later|next (?:day|morning|afternoon|evening|night|week|month|year))\b"
THREAD_RESOLUTION = r"(?i)\b(?:answers?|answered|reveals?|revealed|discloses?|disclosed|describes?|described|explains?|explained|details?|detailed|identifies?|identified|learns?|learned|discovers?|discovered|finds?|found|recovers?|recovered|secures?|secured|logs?|logged|establishes?|established|returns?|returned|departs?|departed|leaves?|left|sets? out|set out|arrives?|arrived|reaches?|reached|enters?|entered|ends?|ended|meets?|met|contacts?|contacted|reports?|reported|delivers?|delivered|presents?|presented|completes?|completed|finishes?|finished|decides?|decided|chooses?|chose|accepts?|accepted|rejects?|rejected|defeats?|defeated|destroys?|destroyed|repairs?|repaired|opens?|opened|closes?|closed|fulfills?|fulfilled|obtains?|obtained|acquires?|acquired|now knows?)\b"
# (goal named in a thread title, action that settles it)
THREAD_RULES = (
    (r"(?i)\b(?:conceal(?:s|ed|ing)?|concealment|keep\b[^.!?;]{0,80}\bhidden)\b", r"(?i)\b(?:discovers?|discovered|reveals?|revealed|exposes?|exposed|learns?|learned|no longer concealed|concealment (?:ends?|ended|fails?|failed|is broken|was broken))\b"),
    (r"(?i)\b(?:answer|description|describe|details?)\b", r"(?i)\b(?:answers?|answered|describes?|described|details?|detailed|explains?|explained|reports?|reported)\b"),
    (r"(?i)\b(?:determin(?:e|es|ed|ing)|unanswered question)\b", r"(?i)\b(?:determines|determined|confirms|confirmed|answers|answered|establishes|established|proves|proved)\b"),
    (r"(?i)\b(?:survive|survival|endure)\b", r"(?i)\b(?:survives|survived|endures|endured|(?:it is|it['’]s|session is|session['’]s) over|(?:ends?|ended)\b[^.!?;]{0,60}\b(?:exchange|fight|combat|attack|assessment|session)|(?:exchange|fight|combat|attack|assessment|session) (?:ends?|ended|is over|was over))\b"),
    (r"(?i)\b(?:assessment|assess|evaluat(?:e|es|ed|ion)|measure|test)\b", r"(?i)\b(?:(?:completes?|completed|concludes?|concluded|finishes?|finished|ends?|ended)\b[^.!?;]{0,100}\b(?:assessment|evaluation|measurement|test)|(?:assesses|assessed|evaluates|evaluated|measures|measured|tests|tested)\b|(?:it is|it['’]s|session is|session['’]s) over\b)"),
    (r"(?i)\b(?:accept|agree|approval|approve|consent)\b", r"(?i)\b(?:accepts?|accepted|agrees?|agreed|approves?|approved|consents?|consented|rejects?|rejected|refuses?|refused|declines?|declined|decides?|decided)\b"),
    (r"(?i)\b(?:receive|receipt)\b", r"(?i)\b(?:receives|received|takes? possession|took possession|accepts delivery|accepted delivery|is handed|was handed)\b"),
    (r"(?i)\b(?:recover|recovery|retrieve|retrieval|obtain|acquire)\b", r"(?i)\b(?:recovers|recovered|retrieves|retrieved|obtains|obtained|acquires|acquired|finds|found|locates|located)\b"),
    (r"(?i)\b(?:depart|departure|travel|journey|arrive|arrival|reach|enter)\b", r"(?i)\b(?:departs?|departed|leaves?|left|travels?|traveled|journeys?|journeyed|arrives?|arrived|reaches?|reached|enters?|entered|is inside|are inside|was inside|were inside|sets? out|set out)\b"),
    (r"(?i)\b(?:deliver|present)\b", r"(?i)\b(?:delivers?|delivered|presents?|presented|gives?|gave|hands?|handed)\b"),
    (r"(?i)\b(?:report|account|explain)\b", r"(?i)\b(?:reported|reports\b[^.!?;]{0,80}\bto|gave\b[^.!?;]{0,80}\breport|gives\b[^.!?;]{0,80}\breport|delivered\b[^.!?;]{0,80}\breport|explains?|explained|discloses?|disclosed)\b"),
    (r"(?i)\b(?:meet|meeting|audience)\b", r"(?i)\b(?:meets?|met|audience (?:begins?|began|occurs?|occurred|concludes?|concluded))\b"),
    (r"(?i)\b(?:request|contact|channel)\b", r"(?i)\b(?:answers?|answered|responds?|responded|contacts?|contacted|live contact|establishes?|established|opens?\b[^.!?;]{0,80}\bchannel|channel\b[^.!?;]{0,80}\bopens?)\b"),
    (r"(?i)\b(?:respond|response|choose|choice|decid(?:e|es|ed|ing)|decision)\b", r"(?i)\b(?:responds?|responded|answers?|answered|chooses?|chose|decides?|decided|accepts?|accepted|rejects?|rejected|retains?|retained|refuses?|refused)\b"),
    (r"(?i)\b(?:leave|remain|stay)\b", r"(?i)\b(?:leaves|left|remains|remained|stays|stayed|chooses|chose|refuses to leave|refused to leave)\b"),
    (r"(?i)\b(?:reveal|disclose|identify|identity|true name|who (?:is|was|are|were))\b", r"(?i)\b(?:reveals?|revealed|discloses?|disclosed|identifies?|identified|answers?|answered|names?|named|learns?|learned|discovers?|discovered)\b"),
    (r"(?i)\b(?:fulfill|complete|completion)\b", r"(?i)\b(?:fulfills?|fulfilled|completes?|completed|finishes?|finished|delivers?|delivered|meets?|met|arrives?|arrived)\b"),
)

# ---- fixed values: beats that a record should cover ------------------------
COVERAGE_STOP_WORDS = tuple(
    "a an and are as at be been being but by for from had has have he her hers him his i in into is it its of on or our "
    "she that the their them they this to was were will with you your".split()
)
COVERAGE_CUES = {
    "agree": r"(?i)\b(?:agree|agrees|agreed|agreeing)\b",
    "appoint": r"(?i)\b(?:appoint|appoints|appointed|appointing)\b",
    "assign": r"(?i)\b(?:assign|assigns|assigned|assigning)\b",
    "become": r"(?i)\b(?:become|becomes|became|becoming)\b",
    "call": r"(?i)\b(?:call|calls|called|calling)\b",
    "decide": r"(?i)\b(?:decide|decides|decided|deciding)\b",
    "discover": r"(?i)\b(?:discover|discovers|discovered|discovering)\b",
    "injure": r"(?i)\b(?:injure|injures|injured|injuring)\b",
    "intend": r"(?i)\b(?:intend|intends|intended|intending)\b",
    "learn": r"(?i)\b(?:learns|learned|learnt)\b",
    "lose": r"(?i)\b(?:lose|loses|lost|losing)\b",
    "name": r"(?i)\b(?:name|names|named|naming)\b",
    "plan": r"(?i)\b(?:plan|plans|planned|planning)\b",
    "promise": r"(?i)\b(?:promise|promises|promised|promising)\b",
    "receive": r"(?i)\b(?:receive|receives|received|receiving)\b",
    "remain": r"(?i)\b(?:remain|remains|remained|remaining)\b",
    "reveal": r"(?i)\b(?:reveal|reveals|revealed|revealing)\b",
    "serve": r"(?i)\b(?:serve|serves|served|serving)\b",
    "suffer": r"(?i)\b(?:suffer|suffers|suffered|suffering)\b",
    "vow": r"(?i)\b(?:vow|vows|vowed|vowing)\b",
    "wound": r"(?i)\b(?:wound|wounds|wounded|wounding)\b",
    "work": r"(?i)\b(?:work|works|worked|working)\b",
    "hold": r"(?i)\b(?:hold|holds|held|holding)\b",
    "answer": r"(?i)\b(?:answer|answers|answered|answering)\b",
    "block": r"(?i)\b(?:block|blocks|blocked|blocking)\b",
    "demonstrate": r"(?i)\b(?:demonstrate|demonstrates|demonstrated|demonstrating)\b",
    "fail": r"(?i)\b(?:fail|fails|failed|failing)\b",
    "struggle": r"(?i)\b(?:struggle|struggles|struggled|struggling)\b",
}
COVERAGE_RELATIONSHIP = r"(?i)\b(?:becomes?|became|remain(?:s|ed)?|are|were)\s+(?:close\s+)?(friends?|allies|enemies|rivals|partners|lovers|spouses?|mentor(?:s)?|students?|masters?|apprentices?)\b"
COVERAGE_COMMITMENT = r"(?i)\b(?:agrees?|agreed|decides?|decided|intends?|intended|plans?|planned|promises?|promised|vows?|vowed)\b\s+(?:to|that|for)\b"
COVERAGE_DESIGNATION = r"(?i)\b(?:(?:was|is|were|are|has been|had been)\s+(?:officially\s+)?(?:named|called|appointed)|(?:serves?|served|works?|worked)\s+as|(?:holds?|held)\s+(?:the\s+)?(?:rank|title|office|position))\b"
COVERAGE_REMAINING_STATE = r"(?i)\b(?:remains?|remained)\b"
COVERAGE_LIMITATION = r"(?i)\b(?:cannot|can't|unable|vulnerab(?:le|ility)|weak(?:ness)?|susceptible|struggles?|struggled|difficulty|limitation|late (?:response|reaction)|slow (?:response|reaction)|fails?|failed)\b"
COVERAGE_CAPABILITY = r"(?i)\b(?:can|able|capable|proficient|skilled|trained|demonstrates?|demonstrated|blocks?|blocked|resists?|resisted|performs?|performed|knows? how)\b"

# ---- fixed values: families of entity types ---------------------------------
ENTITY_TYPE_FAMILIES = {
    "person": "person", "character": "person", "individual": "person", "npc": "person", "human": "person",
    "object": "object", "item": "object", "artifact": "object", "weapon": "object", "tool": "object", "vehicle": "object",
    "place": "place", "location": "place", "site": "place", "region": "place", "world": "place",
    "group": "group", "organization": "group", "organisation": "group", "faction": "group", "institution": "group", "team": "group",
}
ENTITY_TYPE_BLANK = ("entity", "unknown", "other")
PERSON_TYPE_WORDS = (
    "person|character|individual|npc|human|adult|child|man|woman|boy|girl|captain|commander|officer|soldier|guard|pilot|agent|investigator|"
    "detective|leader|ruler|king|queen|prince|princess|emperor|empress|lord|lady|master|mentor|teacher|instructor|student|pupil|apprentice|"
    "padawan|parent|mother|father|brother|sister|sibling|spouse|husband|wife|attendant|retainer|servant|handler|prisoner|captor|captive|"
    "doctor|physician|nurse|engineer|scientist|scholar|archivist|mage|wizard|witch|priest|cleric"
)
OBJECT_TYPE_WORDS = "object|item|artifact|weapon|tool|vehicle|device|equipment|book|document|letter|key|sword|gun|ship|shuttle|car|aircraft"
PLACE_TYPE_WORDS = (
    "place|location|site|region|world|planet|moon|city|town|village|district|room|building|base|station|fort|castle|house|home|road|bridge|"
    "forest|desert|island"
)
GROUP_TYPE_WORDS = "group|organization|organisation|faction|institution|team|family|clan|guild|army|fleet|council|government|company|corporation|order"
LIFE_TYPE_WORDS = "dead|deceased|living"
AGE_TYPE_WORDS = "young|elderly"

# ---- fixed values: people named by their owner and role ---------------------
PERSON_IDENTITY_ROLE = "(?:master|mentor|teacher|captain|commander|leader|handler|apprentice|student|padawan|pupil|parent|mother|father|brother|sister)"
PERSON_IDENTITY_SPECIALIZATION = r"(?:[\p{L}\p{N}-]+\s+){0,3}"
DESCRIPTIVE_PERSON_IDENTITY = (
    rf"(?i)^(.+?)[’']s\s+((?:(?:former|dead|deceased|missing|unknown)\s+)?{PERSON_IDENTITY_SPECIALIZATION}{PERSON_IDENTITY_ROLE})$"
)
#: the same form over every role an identity may carry, which relationships state as well
OWNER_ROLE_IDENTITY = DESCRIPTIVE_PERSON_IDENTITY.replace(PERSON_IDENTITY_ROLE, f"(?:{'|'.join(IDENTITY_ROLE_TOKENS)})")
MIXED_OWNER_PERSON_IDENTITY = (
    r"(?i)^(.+?)[’']s\s+((?:(?:former|previous|prior|lost|missing|dead|deceased|unknown|unnamed|unidentified)\s+)?"
    rf"{PERSON_IDENTITY_SPECIALIZATION}{PERSON_IDENTITY_ROLE})\s+of\s+(.+)$"
)

# ---- fixed values: forms of address without an addressee --------------------
GENERIC_ADDRESS_CATEGORY = r"^(?:social address|forms? of address)$"
GENERIC_ADDRESS_USE = r"^(?:uses?|used) (?:the )?(?:address|address form|form of address|nickname)$"

# ---- fixed values: roles that state a relationship ----------------------------
RELATIONSHIP_ROLE_WORDS = (
    "apprenticeship|apprentices?|students?|padawans?|pupils?|prot[eé]g[eé]s?|mentors?|mentees?|teachers?|instructors?|parents?|mothers?|fathers?|"
    "children|sons?|daughters?|siblings?|brothers?|sisters?|spouses?|husbands?|wives|married|friends?|allies|rivals?|enemies|attendants?|"
    "retainers?|servants?|employers?|employees?|commanders?|subordinates?|teammates?|partners?|captors?|captives?|prisoners?|guardians?|wards?"
)
HISTORICAL_MENTOR_RELATIONSHIP = (
    r"(?i)\b(?:master|mentor|teacher|instructor)\b[^.!?;]{0,80}\b(?:apprentice|padawan|student|pupil|prot[eé]g[eé])\b|"
    r"\b(?:apprentice|padawan|student|pupil|prot[eé]g[eé])\b[^.!?;]{0,80}\b(?:master|mentor|teacher|instructor)\b"
)
