"""Word lists and names whose content decides results."""

# --- fixed values, in natural order ---------------------------------------------------------------

LEGAL_STOPWORDS = frozenset(
    """
    inc incorporated llc ltd limited pvt private corp corporation
    co company llp pllc lp pc pa gmbh sa sarl sas spa
    the and of in at for on with to by an a
    services service enterprise enterprises group holdings holding
    solutions technologies technology consulting management international
    """.split()
)

ADDR_STOPWORDS = frozenset(
    """
    st street rd road ave avenue dr drive blvd boulevard
    ln lane ct court cir circle way pkwy parkway hwy highway
    suite ste unit apt apartment floor fl bldg building no room
    rm near opp opposite behind bh cross main sector plot
    north south east west n s e w box pobox post office
    the and of in at for on with to by an a
    house flat tower block phase nagar colony marg bhavan
    residency enclave complex arcade plaza market lane
    al ak az ar ca co ct de fl ga hi id il in ia
    ks ky la me md ma mi mn ms mo mt ne nv nh nj
    nm ny nc nd oh ok or pa ri sc sd tn tx ut vt
    va wa wv wi wy usa india france
    """.split()
)

STREET_ABBREVIATIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "cir": "circle", "ste": "suite",
    "apt": "apartment", "fl": "floor", "bldg": "building", "sq": "square", "ctr": "center",
}

#: Replaced in this order, so that a word goes before its own beginning.
INDIC_KEYWORDS = {
    "प्राइवेट": "private", "प्रा": "pvt", "लिमिटेड": "limited", "लि": "ltd", "लॉजिस्टिक्स": "logistics",
    "इंटरप्राइजेज": "enterprises", "सॉल्यूशंस": "solutions", "टेक्नोलॉजीज": "technologies",
    "सर्विसेज": "services", "ट्रेडर्स": "traders", "उद्योग": "udyog", "इन्वेस्टमेंट्स": "investments",
    "कंसल्टेंसी": "consultancy",
}

NULL_WORDS = ("nan", "none", "null", "")
UNKNOWN_COUNTRY = "UNKNOWN"

FEATURE_NAMES = (
    "name_exact_match",
    "name_jaccard",
    "name_containment",
    "name_ngram_jaccard_3",
    "name_ngram_jaccard_4",
    "name_edit_sim",
    "name_token_sort_sim",
    "name_jaro_winkler",
    "name_lcs_ratio",
    "name_len_ratio",
    "name_acronym_match",
    "name_prefix_match",
    "name_soundex_match",
    "addr_null",
    "addr_exact_match",
    "addr_jaccard",
    "addr_containment",
    "addr_word_jaccard",
    "addr_word_containment",
    "addr_edit_sim",
    "addr_jaro_winkler",
    "addr_house_num_match",
    "addr_house_num_conflict",
    "addr_house_num_overlap_count",
    "addr_shingle_overlap_count",
    "addr_len_ratio",
    "name_in_addr_cross_match",
    "addr_in_name_cross_match",
    "joint_name_addr_sim",
    "harmonic_mean_jw",
    "shared_tokens_total_count",
    "country_match",
    "is_source3",
)
#: Left out of the set of 28 features.
NOT_IN_28 = (
    "name_prefix_match",
    "name_soundex_match",
    "addr_word_jaccard",
    "addr_word_containment",
    "addr_house_num_conflict",
)
