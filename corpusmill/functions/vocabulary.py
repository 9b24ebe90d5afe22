"""Markers, names and patterns that decide results. Order matters where the first match wins."""

# Chunk type by markers in content and heading, first match wins.
CHUNK_TYPES = (
    (["recommendation", "we recommend", "we suggest", "strong recommendation"], "recommendation"),
    (["practice point", "good practice", "expert opinion", "consensus"], "practice_point"),
    (["rationale", "basis for", "justification", "reasoning"], "rationale"),
    (["evidence", "systematic review", "meta-analysis", "rct", "trial data"], "evidence_summary"),
    (["special population", "exception", "caution", "avoid in", "contraindicated"], "clinical_consideration"),
    (["definition", "criteria", "staging", "classification", "diagnostic"], "definition_criteria"),
    (["algorithm", "flowchart", "decision tree", "pathway"], "algorithm"),
    (["table", "comparison table", "reference values", "summary table"], "table"),
    (["monitoring", "follow-up", "review interval", "target", "parameter"], "monitoring"),
    (["dosing", "dose", "dosage", "regimen", "mg/kg", "mg/day"], "drug_dosing"),
    (["lifestyle", "diet", "exercise", "self-management", "patient education"], "patient_guidance"),
    (["key points", "summary", "key messages", "in brief"], "summary"),
    (["background", "epidemiology", "pathophysiology", "introduction"], "background"),
)
VALID_CHUNK_TYPES = [
    "recommendation", "practice_point", "rationale", "evidence_summary", "clinical_consideration", "definition_criteria",
    "algorithm", "table", "background", "monitoring", "drug_dosing", "patient_guidance", "summary",
]
SIGNALS = ["recommend", "suggest", "evidence", "treatment", "therapy", "patient", "clinical", "diagnosis", "monitor", "dose", "mg", "risk", "guideline", "standard", "protocol"]

# Grade symbol: strength, quality, direction.
GRADES = {
    "1a": ("strong", "high", "for"), "1b": ("strong", "moderate", "for"), "1c": ("strong", "low", "for"), "1d": ("strong", "very_low", "for"),
    "2a": ("conditional", "high", "for"), "2b": ("conditional", "moderate", "for"), "2c": ("conditional", "low", "for"), "2d": ("conditional", "very_low", "for"),
    "a": ("strong", "high", "for"), "b": ("strong", "moderate", "for"), "c": ("conditional", "low", "for"), "e": ("expert_opinion", "very_low", "for"),
    "strong": ("strong", None, "for"), "conditional": ("conditional", None, "for"),
}
STRENGTHS = (
    ("strong recommendation", "strong"), ("we strongly recommend", "strong"), ("we recommend", "strong"), ("is recommended", "strong"), ("are recommended", "strong"), ("should be", "strong"),
    ("conditional recommendation", "conditional"), ("we suggest", "conditional"), ("may be considered", "conditional"),
    ("good practice statement", "expert_opinion"), ("good practice", "expert_opinion"), ("expert opinion", "expert_opinion"),
)
EVIDENCE = (
    ("high certainty", "high"), ("high-certainty", "high"), ("moderate certainty", "moderate"), ("low certainty", "low"), ("very low certainty", "very_low"), ("very-low certainty", "very_low"),
    ("grade a", "high"), ("level a", "high"), ("grade b", "moderate"), ("level b", "moderate"), ("grade c", "low"), ("level c", "low"), ("level 1", "high"), ("level 2", "moderate"),
)
# Where a recommendation begins, in journal articles, and in guideline documents, which have numbered and lettered ones beside.
RECOMMENDATION_IN_ARTICLES = (
    "(?:[Ww]e (?:strongly )?recommend\\b|[Ww]e (?:weakly )?suggest\\b|[Ss]trong recommendation|[Cc]onditional recommendation|[Gg]ood practice statement|[Ii]t is recommended|"
    "[Ss]hould be (?:offered|used|given|provided|initiated|started)\\b|[Ii]s recommended for\\b|[Aa]re recommended for\\b|"
    "\\((?:strong|conditional|weak),\\s*(?:high|moderate|low|very low)[^\\)]{0,30}\\)|\\([12][ABCD]\\)|\\([Gg]rade\\s+[ABCE]\\)|(?:STRONG|CONDITIONAL)\\s+RECOMMENDATION)"
)
RECOMMENDATION = RECOMMENDATION_IN_ARTICLES[:-1] + "|[Rr]ecommendation\\s+\\d+[.:]\\s*|^[A-Z]\\.\\s+(?:We |It |All |Patients ))"
# A recommendation's number, text and grade: with a grade in parentheses, with a grade letter at the end, or with a number alone.
RECOMMENDATION_NUMBERED = "(?i)^(\\d+(?:\\.\\d+){1,3}[a-z]?)\\s+(.+?)[\\s.]+\\(([12][ABCD])\\)"
RECOMMENDATION_LETTERED = "(?is)^(\\d+\\.\\d+[a-z]?)\\s+(.+)\\s+([ABCE])$"
RECOMMENDATION_PLAIN = "(?is)^(R\\d+|Recommendation\\s+\\d+)[:\\s]+(.+)"
RECOMMENDATION_BRACKET = "(?i)\\[(strong|conditional)\\]"
# What makes a segment one of reasons, and one of doses.
REASONS = ("(?i)\\bevidence\\b", "(?i)\\btrial\\b", "(?i)\\bmeta.analysis\\b", "(?i)\\bsystematic review\\b", "(?i)\\bRCT\\b", "(?i)\\bstudy\\b")
DOSES = "(?i)(?:\\d+\\s*mg|\\d+\\s*mcg|\\d+\\s*g\\b|\\d+\\s*ml\\b|\\d+\\s*(?:tablet|capsule|vial|unit|IU|dose)s?\\b|twice daily|once daily|BD|TDS|OD\\b|per kg|mg/kg)"
DOSAGE = ("\\d+\\s*mg", "\\d+\\s*mcg", "\\d+\\s*μg", "\\d+\\s*mg/kg", "\\d+\\s*mg/day", "\\d+\\s*units", "once daily", "twice daily", "three times", "oral dose", "iv dose", "loading dose")
POPULATIONS = {
    "adults": ["(?i)\\badult[s]?\\b"],
    "children": ["(?i)\\bchild(?:ren)?\\b", "(?i)\\bpediatric\\b", "(?i)\\bpaediatric\\b"],
    "infants": ["(?i)\\binfant[s]?\\b", "(?i)\\bneonatal\\b", "(?i)\\bnewborn\\b"],
    "pregnant": ["(?i)\\bpregnant\\b", "(?i)\\bpregnancy\\b", "(?i)\\bmaternal\\b", "(?i)\\bantenatal\\b"],
    "adolescents": ["(?i)\\badolescent[s]?\\b", "(?i)\\bteenager[s]?\\b"],
    "hiv_positive": ["(?i)\\bPLHIV\\b", "(?i)\\bHIV.positive\\b", "(?i)\\bpeople living with HIV\\b"],
}
INTERVENTIONS = {
    "dolutegravir": ["(?i)\\bdolutegravir\\b", "(?i)\\bDTG\\b"],
    "ART": ["(?i)\\bantiretroviral\\b", "(?i)\\bART\\b", "(?i)\\bHAART\\b"],
    "cotrimoxazole": ["(?i)\\bcotrimoxazole\\b", "(?i)\\btrimethoprim.sulfamethoxazole\\b"],
    "ACT": ["(?i)\\bartemisinin.based combination\\b", "(?i)\\bACT\\b"],
    "artemether-lumefantrine": ["(?i)\\bartemether.lumefantrine\\b", "(?i)\\bCoartem\\b"],
    "isoniazid": ["(?i)\\bisoniazid\\b", "(?i)\\bINH\\b"],
    "rifampicin": ["(?i)\\brifampicin\\b", "(?i)\\brifampin\\b"],
    "oxytocin": ["(?i)\\boxytocin\\b"],
    "misoprostol": ["(?i)\\bmisoprostol\\b"],
    "metformin": ["(?i)\\bmetformin\\b"],
    "insulin": ["(?i)\\binsulin\\b"],
    "iron-supplements": ["(?i)\\biron supplement\\b", "(?i)\\bferrous\\b"],
    "folic-acid": ["(?i)\\bfolic acid\\b", "(?i)\\bfolate\\b"],
}
DRUG_FRAGMENTS = [
    "metformin", "empagliflozin", "dapagliflozin", "canagliflozin", "sitagliptin", "glipizide", "glibenclamide", "insulin", "atorvastatin", "rosuvastatin", "aspirin", "warfarin", "furosemide",
    "spironolactone", "amlodipine", "lisinopril", "enalapril", "losartan", "ramipril", "bisoprolol", "tenofovir", "lamivudine", "efavirenz", "dolutegravir", "nevirapine", "lopinavir", "ritonavir",
    "atazanavir", "artemether", "lumefantrine", "quinine", "coartem", "amoxicillin", "azithromycin", "doxycycline", "cotrimoxazole", "prednisolone", "dexamethasone", "hydrocortisone",
]
SKIPPED_SECTIONS = [
    "references", "bibliography", "acknowledgements", "acknowledgments", "conflict of interest", "funding", "abbreviations", "glossary", "annex", "appendix", "contents", "table of contents",
    "foreword", "preface", "acronyms", "list of tables", "list of figures",
]
TIERS = ((["randomized", "rct", "systematic review", "meta-analysis"], 1), (["cohort", "observational", "registry", "case-control"], 2))

# Domains, document types, frameworks and scopes that rows may have, and what other spellings become.
DOMAINS = [
    "general_medicine", "emergency_medicine", "critical_care", "anaesthesia", "pharmacology", "public_health", "palliative_care", "other", "cardiology", "respiratory", "infectious_disease", "hiv",
    "obstetrics", "gynaecology", "paediatrics", "oncology", "haematology", "endocrinology", "nephrology", "urology", "gastroenterology", "hepatology", "neurology", "mental_health", "dermatology",
    "rheumatology", "orthopaedics", "ophthalmology", "surgery", "radiology",
]
DOMAIN_NAMES = {
    "maternal": "obstetrics", "neonatal": "paediatrics", "tb": "infectious_disease", "tuberculosis": "infectious_disease", "malaria": "infectious_disease", "sti": "infectious_disease",
    "amr": "infectious_disease", "ntd": "infectious_disease", "enteric": "infectious_disease", "hepatitis": "hepatology", "diabetes": "endocrinology", "cardiovascular": "cardiology",
    "cardiac": "cardiology", "nutrition": "public_health", "vaccines": "public_health", "reproductive": "gynaecology", "reproductive_health": "gynaecology", "emergency": "emergency_medicine",
    "palliative": "palliative_care", "mixed": "general_medicine", "who": "general_medicine", "hematology": "haematology", "mental health": "mental_health",
}
DOCUMENT_TYPES = ["guideline", "protocol", "summary", "pocket_guide", "consensus_statement", "position_statement"]
FRAMEWORKS = ["GRADE", "Oxford", "SIGN", "AHA_ACC", "unspecified", "RCOG grading", "RCOG", "NICE", "ADA", "WHO", "ESMO", "ESC", "EULAR", "other"]
FRAMEWORK_NAMES = {
    "grade": "GRADE", "oxford": "Oxford", "sign": "SIGN", "aha_acc": "AHA_ACC", "aha/acc": "AHA_ACC", "rcog grading": "RCOG grading", "rcog": "RCOG", "nice": "NICE", "ada": "ADA", "who": "WHO",
    "esmo": "ESMO", "esc": "ESC", "eular": "EULAR", "unspecified": "unspecified",
}
SCOPES = ["global", "kenya", "east_africa", "sub_saharan_africa", "africa", "other"]
SCOPE_NAMES = {"east africa": "east_africa", "sub-saharan": "sub_saharan_africa", "sub saharan": "sub_saharan_africa", "sub_saharan": "sub_saharan_africa"}
ROW_STRENGTHS = {
    "strong": "strong", "strong for": "strong", "strong against": "strong", "conditional": "conditional", "conditional for": "conditional", "conditional against": "conditional", "weak": "weak",
    "good practice": "expert_opinion", "expert_opinion": "expert_opinion", "expert opinion": "expert_opinion",
}
ROW_QUALITIES = {"high": "high", "moderate": "moderate", "low": "low", "very low": "very_low", "very_low": "very_low"}
PLACES = (
    (["kenya", "uganda", "tanzania", "ethiopia", "rwanda", "east africa", "east african", "eastern africa"], "east_africa"),
    (["africa", "african", "sub-saharan", "sub saharan"], "africa"),
    (["low-income", "middle-income", "lmic", "developing countr", "resource-limited", "resource limited"], "lmic"),
    (["europe", "european", "uk ", "british", "france", "germany", "spain", "italy"], "europe"),
    (["united states", "american", "canada", "north america"], "north_america"),
)
# Issuing bodies by a substring of their name, first match wins.
BODIES = (
    ("world health organization", "WHO"), ("world health organisation", "WHO"), ("who", "WHO"), ("nice", "NICE"), ("national institute for health and care excellence", "NICE"), ("cochrane", "Cochrane"),
    ("kdigo", "KDIGO"), ("esc", "ESC"), ("european society of cardiology", "ESC"), ("ada", "ADA"), ("american diabetes association", "ADA"), ("idf", "IDF"), ("international diabetes federation", "IDF"),
    ("aha", "AHA"), ("american heart association", "AHA"), ("idsa", "IDSA"), ("infectious diseases society of america", "IDSA"), ("eacs", "EACS"), ("ash", "ASH"), ("american society of hematology", "ASH"),
    ("eular", "EULAR"), ("esmo", "ESMO"), ("wses", "WSES"), ("figo", "FIGO"), ("easl", "EASL"), ("aasld", "AASLD"), ("ers", "ERS"), ("european respiratory society", "ERS"), ("ats", "ATS"),
    ("american thoracic society", "ATS"), ("acr", "ACR"), ("american college of rheumatology", "ACR"), ("sahcs", "SAHCS"), ("southern african hiv clinicians", "SAHCS"), ("bhiva", "BHIVA"),
    ("british hiv association", "BHIVA"), ("africa cdc", "Africa CDC"), ("africa centres for disease control", "Africa CDC"), ("eha", "EHA"), ("european hematology association", "EHA"), ("esge", "ESGE"),
    ("european society of gastrointestinal endoscopy", "ESGE"), ("rcog", "RCOG"), ("royal college of obstetricians", "RCOG"), ("sso", "SSO"), ("society of surgical oncology", "SSO"),
)
# Publication type to document type; an empty one is left out of the corpus.
PUBLICATION_TYPES = {
    "practice guideline": "clinical_practice_guideline", "guideline": "clinical_practice_guideline", "consensus development conference": "consensus_statement",
    "consensus development conference, nih": "consensus_statement", "systematic review": "systematic_review", "meta-analysis": "meta_analysis", "network meta-analysis": "network_meta_analysis",
    "cochrane review": "systematic_review", "randomized controlled trial": "randomized_controlled_trial", "randomized controlled trial, veterinary": "", "pragmatic clinical trial": "clinical_trial",
    "adaptive clinical trial": "clinical_trial", "equivalence trial": "clinical_trial", "clinical trial": "clinical_trial", "clinical trial, phase i": "clinical_trial",
    "clinical trial, phase ii": "clinical_trial", "clinical trial, phase iii": "clinical_trial", "clinical trial, phase iv": "clinical_trial", "controlled clinical trial": "clinical_trial",
    "multicenter study": "clinical_trial", "comparative effectiveness research": "clinical_trial", "observational study": "observational_study", "cohort study": "observational_study",
    "cross-sectional study": "observational_study", "validation study": "observational_study", "diagnostic test accuracy study": "observational_study", "twin study": "observational_study",
    "review": "review_article", "scoping review": "scoping_review", "case reports": "case_report", "editorial": "", "letter": "", "news": "", "comment": "", "patient education handout": "",
    "published erratum": "", "retracted publication": "", "preprint": "",
}
TYPE_TIERS = {
    "clinical_practice_guideline": 1, "consensus_statement": 1, "systematic_review": 2, "meta_analysis": 2, "network_meta_analysis": 2, "randomized_controlled_trial": 3, "clinical_trial": 3,
    "review_article": 4, "scoping_review": 4, "observational_study": 4, "case_report": 5, "research_article": 5,
}
ARTICLE_MARKERS = (
    (["practice-guideline", "practice guideline"], "clinical_practice_guideline"), (["systematic-review", "systematic review"], "systematic_review"), (["meta-analysis"], "meta_analysis"),
    (["clinical-trial", "randomized"], "randomized_controlled_trial"), (["review"], "review_article"),
)
TITLE_MARKERS = (
    (["guideline", "guidance", "recommendation", "consensus", "protocol", "standard of care"], "clinical_practice_guideline"),
    (["systematic review", "meta-analysis", "meta analysis", "cochrane review"], "systematic_review"),
    (["randomized", "randomised", " rct", "clinical trial"], "randomized_controlled_trial"),
    (["review"], "review_article"),
)
# Issuing bodies of the first three ranks, by a substring of their name.
RANKS = (
    (["who", "world health organization", "world health organisation", "nice", "national institute for health and care excellence", "cochrane", "kdigo", "africa cdc", "africa centres for disease control"], 1),
    ([
        "esc", "european society of cardiology", "ada", "american diabetes association", "aha", "american heart association", "acc", "american college of cardiology", "eacs",
        "european aids clinical society", "idsa", "infectious diseases society of america", "isth", "international society on thrombosis", "figo", "international federation of gynecology", "wses",
        "world society of emergency surgery", "eras", "enhanced recovery after surgery", "wgo", "world gastroenterology organisation", "eular", "european league against rheumatism", "esmo",
        "european society for medical oncology", "asco", "american society of clinical oncology", "espen", "european society for clinical nutrition", "ash", "american society of hematology", "aasld",
        "american association for study of liver", "easl", "european association for the study of the liver", "aan", "american academy of neurology", "ean", "european academy of neurology", "sccm",
        "society of critical care medicine", "surviving sepsis", "ers", "european respiratory society", "ats", "american thoracic society", "idf", "international diabetes federation", "sahcs",
        "southern african hiv clinicians society", "bhiva", "british hiv association", "acr", "american college of rheumatology", "aap", "american academy of pediatrics", "who afro",
        "regional office for africa", "eha", "european hematology association", "esge", "european society of gastrointestinal endoscopy", "rcog", "royal college of obstetricians", "sso",
        "society of surgical oncology",
    ], 2),
)
THIRD_RANK = [
    "ministry of health", "national guidelines", "nascop", "government", "national institute", "health authority", "kenya medical research", "kemri", "kenya ministry", "national aids",
    "east african community", "amref",
]
NON_CLINICAL = [
    "animals", "rats", "mice", "mouse model", "murine", "rodent", "dogs", "cattle", "swine", "in vitro", "cell line", "cell culture", "geology", "seismic", "earthquake", "mineral", "cryptocurrency",
]
CLINICAL = ["patient", "clinical", "guideline", "human", "treatment", "diagnosis"]
# Abbreviations, replaced in this order.
ABBREVIATIONS = {
    "ARV": "antiretroviral", "ARVs": "antiretroviral", "ART": "antiretroviral therapy", "TB": "tuberculosis", "MDR-TB": "multidrug resistant tuberculosis", "PPH": "postpartum haemorrhage",
    "PE": "pre-eclampsia", "SAM": "severe acute malnutrition", "COPD": "chronic obstructive pulmonary disease", "CAP": "community acquired pneumonia", "UTI": "urinary tract infection",
    "RDS": "respiratory distress syndrome", "HTN": "hypertension", "DM": "diabetes mellitus", "T2DM": "type 2 diabetes", "ACS": "acute coronary syndrome", "HF": "heart failure",
    "PPROM": "preterm premature rupture membranes", "PROM": "premature rupture membranes", "IgAN": "IgA nephropathy", "CKD": "chronic kidney disease", "GDM": "gestational diabetes",
    "PIH": "pregnancy induced hypertension", "APH": "antepartum haemorrhage", "PID": "pelvic inflammatory disease", "STI": "sexually transmitted infection", "SLE": "systemic lupus erythematosus",
    "RA": "rheumatoid arthritis", "OA": "osteoarthritis", "NEC": "necrotising enterocolitis", "IVH": "intraventricular haemorrhage", "BPD": "bronchopulmonary dysplasia",
    "ROP": "retinopathy of prematurity", "AKI": "acute kidney injury", "DKA": "diabetic ketoacidosis", "AFI": "amniotic fluid index", "FGR": "fetal growth restriction",
    "IUGR": "intrauterine growth restriction", "GBS": "group B streptococcus", "PCOS": "polycystic ovary syndrome", "CVD": "cardiovascular disease", "AVN": "avascular necrosis",
    "DVT": "deep vein thrombosis", "VTE": "venous thromboembolism",
}
# Words of questions that no document is searched for.
QUERY_STOP = [
    "when", "what", "how", "why", "where", "which", "who", "whom", "should", "would", "could", "can", "may", "might", "must", "shall", "used", "use", "given", "give", "prescribed", "prescribe",
    "have", "has", "had", "been", "being", "does", "doing", "want", "need", "like", "find", "instead", "versus", "compared", "from", "with", "without", "about", "above", "after", "before", "during",
    "between", "into", "onto", "upon", "also", "then", "thus", "iv", "im", "sc", "po", "od", "bd", "tds", "qds", "patient", "patients", "year", "years", "old", "aged", "age", "male", "female",
    "woman", "women", "man", "men", "boy", "girl", "para", "gravida", "parity", "weeks", "days", "months", "trimester", "gestation", "gestational", "presenting", "presented", "presents",
    "presentation", "complains", "complaining", "complained", "complaint", "noticed", "developed", "diagnosed", "known", "history", "background", "baseline", "current", "recent",
]
PHRASE_STOP = ["what", "when", "where", "which", "how", "why", "who", "did", "does", "the", "and", "for", "from", "with", "show", "shows", "trial", "study", "patient", "patients"]
SUGGESTION_STOP = [
    "what", "which", "should", "would", "could", "given", "after", "before", "during", "about", "these", "their", "there", "where", "when", "while", "since", "until", "other", "first", "second",
]
DRUG_QUESTION = "(?i)\\b(side effects?|adverse effects?|doses?|dosing|dosage|drug interactions?|contraindications?)\\b"
NUTRITION = ["f75", "f100", "rutf", "plumpy", "ors", "ebm", "formula", "therapeutic milk", "therapeutic food"]
DRUG_MARKERS = "(?i)\\b(\\d+\\s*mg|\\d+\\s*mcg|\\d+\\s*ml/kg|\\d+\\s*iu\\b|tablets?|capsules?|intravenous|infusion|injection|oral dose)\\b"

# How headings look. In markdown, as a line of upper-case letters, and as a numbered line.
MARKDOWN_HEADING = "(?m)^(#{1,3})\\s+(.+)$"
CAPITAL_HEADING = "(?m)^(?=\\S+(?:[ \\t]+\\S+){0,7}[ \\t]*$)([A-Z][A-Z \\t\\d/\\-]{4,60})[ \\t]*$"
NUMBERED_HEADING = "(?m)^(\\d+(?:\\.\\d+)*\\.?\\s+[A-Z][^\\n]{3,60})$"
# Proper names in a question. Acronyms in parentheses, capitalised phrases, upper-case words, and what stands before
# a trial or a study.
ACRONYM_INSIDE = "\\(([A-Z][A-Z0-9-]{2,})\\)"
CAPITAL_PHRASE = "\\b((?:[A-Z][a-zA-Z]{2,}|[A-Z]{2,})(?:\\s+(?:(?:[A-Z][a-zA-Z]+|[A-Z]{2,})|(?:in|of|and|the)))*\\s+(?:[A-Z][a-zA-Z]+|[A-Z]{2,}))\\b"
UPPER_WORDS = "\\b([A-Z]{3,}(?:\\s+[A-Z]{3,})*)\\b"
BEFORE_TRIAL = "\\b((?:\\w+\\s+){1,3})(?:trial|study)\\b"
