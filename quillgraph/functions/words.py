"""Fixed word lists and class tables."""

# Public English stop-word list (contractions without their
# apostrophe parts, which the normaliser splits off) and the domain words.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# Words too common in scientific prose to carry meaning.
DOMAIN = (
    "doi fig figure et al paper study research method results analysis data proposed "
    "approach using based used show shown table section"
).split()

STOP_WORDS = ENGLISH + DOMAIN

# Class id to class name.
CLASS_NAMES = {
    1: "Artificial Intelligence",
    2: "Data Science",
    3: "Interface",
    4: "Computer Vision",
    5: "Network",
    6: "Theoretical CS",
    7: "Specific Applications",
    8: "Other",
}

# Venue keywords, tried from class 1 to class 7; class 8 is the rest.
VENUE_KEYWORDS = {
    1: ["machine learning", "artificial intelligence", "neural", "autonomous", "agent",
        "nlp", "natural language"],
    2: ["data", "information system", "database", "mining", "cleaning",
        "business intelligence"],
    3: ["visualization", "interface", "interaction", "hci"],
    4: ["vision", "image", "2d", "3d", "virtual reality"],
    5: ["network", "system", "security", "mobile", "iot", "web"],
    6: ["theory", "theorem", "proof", "bound", "calculability", "compilation", "game theory"],
    7: ["humanities", "biology", "medicine", "chemistry", "physics", "social"],
}
OTHER_CLASS = 8
