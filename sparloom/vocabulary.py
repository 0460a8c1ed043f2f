"""Fixed values of the annotation and curation domain: vocabularies, column lists, word lists, thresholds."""

from __future__ import annotations

# White space, and with it the punctuation that counts as nothing when characters are compared.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = "，。、'：:；;,.!！?？/|（）()[]{}<>《》-"

# Views, statuses and enumerations of annotation tables.
VIEWS = ("front", "side", "back")
VIEW_VALUES = ("front", "side", "back", "multiple", "all", "unknown")
ISSUE_TYPES = ("wrong color", "wrong material", "wrong shape", "paired box completion", "missing", "extra", "wrong invisible", "other")
SEVERITIES = ("critical", "major", "minor", "unknown", "")
OPTIONAL_VISIBLE = ("visible", "invisible", "unknown", "")
MATCH_STATUSES = ("correct", "wrong", "unsure", "")
RULE_VALIDITIES = ("correct", "wrong_value", "missing_from_2d", "ambiguous", "out_of_scope", "duplicate")
VISIBLE = ("visible", "invisible")
STATUS_IF_VISIBLE = ("correct", "wrong color", "wrong material", "wrong shape", "wrong_prosition", "extra")
STATUS_IF_INVISIBLE = ("correct", "wrong invisible")
ERROR_STATUSES = ("wrong color", "wrong material", "wrong shape", "wrong_prosition", "extra", "wrong invisible")
REVIEW_STATUS_IF_VISIBLE = ("correct", "wrong color", "wrong material", "wrong shape", "wrong_prosition", "paired box completion", "extra")
REVIEW_ERROR_STATUSES = ("wrong color", "wrong material", "wrong shape", "wrong_prosition", "paired box completion", "extra", "wrong invisible")
RESULTS = ("correct", "wrong")
ACCEPTANCE_ISSUES = ("wrong color", "wrong material", "wrong shape", "paired box completion")
DESIGN_ISSUES = ("extra", "wrong invisible", "ambiguous", "other")
STATUS_REPAIRS = {"wrong_color": "wrong color", "wrong_material": "wrong material", "wrong_shape": "wrong shape", "paired_box_completion": "paired box completion", "wrong_invisible": "wrong invisible", "wrong": "wrong shape"}
CONFIDENCE_WORDS = {"high": 0.95, "very high": 0.95, "medium": 0.75, "low": 0.5}

# Column lists.
FINDING_COLUMNS = ("sample_id", "category", "finding_id", "view", "issue_type")
FINDING_OPTIONAL = ("human_rule_name", "element_name", "attribute", "bbox_2d", "bbox_multiview", "visible", "status", "match_status", "expected_value", "observed_value", "feature_key", "expected_from_2d", "observed_in_multiview", "severity", "source_2d_evidence", "multiview_evidence", "reason", "annotator_id", "annotation_batch")
GOLD_COLUMNS = ("sample_id", "rule_id", "value", "front_visible", "front_status", "side_visible", "side_status", "back_visible", "back_status", "result")
AUDIT_COLUMNS = ("sample_id", "category", "rule_id", "rule_key", "atomic_value", "rule_validity", "corrected_value", "reason", "annotator_id", "annotation_batch")
VERIFIED_COLUMNS = ("sample_id", "category", "rule_id", "value", "front_visible", "front_status", "side_visible", "side_status", "back_visible", "back_status", "result", "issue_type", "confidence", "reason", "audit_rule_validity", "audit_reason")
RULE_QUALITY_COLUMNS = ("sample_id", "category", "rule_id", "atomic_value", "rule_validity", "corrected_value", "reason")
PREDICTION_COLUMNS = (*GOLD_COLUMNS, "issue_type", "confidence", "reason")

# Words of rule texts that carry no meaning, and forms of one word.
STOPWORDS = ("a", "an", "and", "are", "has", "have", "is", "of", "the", "with")
ALIASES = {"bang": "bangs", "bows": "bow", "cloth": "clothing", "clothes": "clothing", "colour": "color", "eyes": "eye", "glasses": "glasses", "hat": "headwear", "hoodie": "hood", "ribbons": "ribbon", "shoe": "footwear", "shoes": "footwear", "sock": "legwear", "socks": "legwear"}

# Element categories and object, attribute and colour families.
ELEMENT_CATEGORIES = ("hair", "face", "skin_body", "clothing", "accessory", "headwear", "footwear", "prop", "other")
OBJECT_FAMILIES = {
    "skin": ("皮肤", "肤色", "身体"),
    "hair": ("头发", "发型", "发色", "长发", "短发", "卷发", "直发", "马尾"),
    "eyes": ("眼睛", "眼部", "瞳孔"),
    "ears": ("耳朵", "尖耳"),
    "headwear": ("头巾", "帽子", "便帽", "头饰", "头上戴", "发饰"),
    "coat": ("外衣", "外套", "长外套", "开襟"),
    "shirt": ("内衬", "内搭", "衬衫", "上衣"),
    "belt": ("腰带", "背带", "肩带"),
    "pants": ("裤子", "长裤", "下装", "裤脚", "短裤"),
    "leg_wraps": ("绑腿", "腿部绑带", "小腿处", "小腿"),
    "boots": ("靴子", "短靴", "鞋靴"),
    "wrist_guard": ("护腕", "手臂绑带", "前臂", "双臂"),
    "fur_trim": ("毛皮", "毛绒", "毛边", "包边", "滚边"),
    "gloves": ("手套",),
    "shoes": ("皮鞋", "鞋子", "运动鞋", "高跟鞋", "凉鞋", "球鞋", "布鞋", "鞋"),
    "bracelet": ("手环", "手镯", "手链", "手腕饰"),
    "necklace": ("项链", "项圈", "颈链"),
    "glasses": ("眼镜", "墨镜", "太阳镜"),
    "tail": ("尾巴", "猫尾", "兽尾", "狐狸尾", "龙尾"),
    "claws": ("爪子", "爪足", "趾甲", "兽爪", "脚爪"),
    "skirt": ("裙子", "短裙", "长裙", "百褶裙", "蓬蓬裙", "半身裙", "连衣裙", "洋装"),
    "necktie": ("领结", "领带", "领饰", "蝴蝶结领"),
    "wing": ("翅膀", "羽翼", "双翼", "天使翅"),
    "horn": ("兽角", "犄角", "头角"),
    "weapon": ("武器", "剑", "刀", "弓", "法杖", "魔杖", "长枪"),
    "cloak": ("斗篷", "披风", "披肩", "披巾"),
}
DETAIL_OBJECTS = ("fur_trim", "leg_wraps")
COLOR_FAMILIES = {
    "black": ("黑色", "黑"),
    "blue": ("蓝色", "蓝"),
    "brown_tan": ("棕色", "棕", "褐色", "咖啡", "卡其", "驼色", "浅棕", "深棕", "黄褐", "土黄", "米色", "米白", "杏色"),
    "green": ("绿色", "绿"),
    "grey": ("灰色", "灰"),
    "pink": ("粉色", "粉"),
    "purple": ("紫色", "紫"),
    "red": ("红色", "红"),
    "white": ("白色", "白", "米白"),
    "yellow": ("黄色", "金色", "黄", "金"),
}
MATERIAL_FAMILIES = {"cloth": ("布", "布质", "织物", "棉", "衬衫"), "fur": ("毛皮", "毛绒", "皮毛"), "leather": ("皮革", "皮靴", "软皮"), "metal": ("金属", "铁", "银", "铜")}
SHAPE_FAMILIES = {
    "long": ("长款", "长裤", "长外套", "长发", "长袖", "长裙", "长靴", "长筒", "长辫"),
    "short": ("短款", "短靴", "短发", "短裙", "短裤", "短袖", "短外套"),
    "wide": ("宽松", "宽"),
    "narrow": ("窄款", "修身", "紧身", "贴身"),
    "pointed": ("尖", "尖耳"),
    "round": ("圆形", "圆润"),
    "wrapped": ("缠绕", "包裹", "包边", "滚边", "绑带"),
}
SHAPE_OPPOSITES = (("long", "short"), ("wide", "narrow"), ("pointed", "round"))
ACCESSORY_MATERIAL = r"[金银铜铁](?:属)?搭扣|金属扣[环圈]?|[金银铜](?:属)?纽扣|拉链头|金属扣件"
COLOR_RULE = "tolerated_color_family_v1"
COLOR_ALIASES = {
    "black": ("深蓝黑", "深紫黑", "蓝黑", "紫黑", "黑色", "黑", "black"),
    "dark_gray": ("深灰色", "深灰", "灰黑色", "灰黑", "dark gray", "dark grey"),
    "gray_brown": ("灰褐色", "灰棕色", "灰棕", "gray-brown", "grey-brown"),
    "red_brown": ("红棕色", "红棕", "red-brown", "reddish brown"),
    "dark_brown": ("深棕色", "深棕", "dark brown"),
    "light_brown": ("浅棕色", "浅棕", "light brown"),
    "brown": ("棕色", "棕", "brown"),
    "khaki": ("卡其色", "卡其", "khaki"),
    "tan": ("驼色", "米棕色", "米棕", "tan"),
    "rose": ("玫红色", "玫红", "rose"),
    "pink": ("粉红色", "粉红", "浅粉色", "浅粉", "粉色", "粉", "pink"),
    "red": ("鲜红色", "鲜红", "红色", "红", "red"),
    "silver": ("银白色", "银白", "银色", "银", "silver"),
    "light_gray": ("浅灰色", "浅灰", "light gray", "light grey"),
    "gray": ("灰色", "灰", "gray", "grey"),
    "white": ("白色", "白", "white"),
    "blue_green": ("青绿色", "蓝绿色", "蓝绿", "blue-green"),
    "cyan": ("青色", "青", "cyan"),
    "blue": ("蓝色", "蓝", "blue"),
    "yellow_green": ("黄绿色", "黄绿", "yellow-green"),
    "green": ("绿色", "绿", "green"),
    "purple_red": ("紫红色", "紫红"),
    "purple": ("紫色", "紫"),
    "yellow": ("黄色", "黄"),
    "gold": ("金色", "金"),
    "orange": ("橙色", "橙"),
}
TOLERATED_COLORS = (
    ("red", "pink", "rose", "red_brown"),
    ("red", "brown", "red_brown", "dark_brown", "light_brown", "khaki", "tan"),
    ("black", "dark_gray", "gray_brown", "dark_brown", "brown"),
    ("white", "silver", "light_gray", "gray"),
    ("blue", "cyan", "blue_green"),
    ("green", "yellow_green"),
)

# Product categories, in the order that breaks ties, and tags of the additive scorer.
CATEGORIES = ("head_key_chain", "cake_roll", "backpack", "plush", "dataset_QSitFigures", "dataset_figurine")
HEAD_CATEGORIES = ("head_key_chain", "cake_roll", "backpack")
BODY_CATEGORIES = ("plush", "dataset_QSitFigures", "dataset_figurine")
FRONT_VIEW_TAGS = ("looking_at_viewer", "facing_viewer", "front_view", "from_front")
FEATURE_TAGS = {
    "solo": ("solo",),
    "full_body": ("full_body",),
    "standing": ("standing",),
    "sitting": ("sitting", "kneeling", "crouching"),
    "multi_view": ("multiple_views", "turnaround", "character_sheet", "from_side", "from_behind", "profile"),
    "simple_bg": ("transparent_background", "simple_background", "white_background"),
    "weapon": ("weapon", "holding_weapon", "sword", "gun", "rifle", "polearm", "spear", "scythe"),
    "armor": ("armor", "armored_boots", "greaves", "helmet"),
    "appendage": ("wings", "wing", "tail", "horns", "animal_ears", "pointy_ears"),
    "head_feature": ("hat", "hair_ornament", "hair_ribbon", "hair_bow", "bow", "ribbon", "animal_ears", "horns", "pointy_ears", "twintails", "ponytail", "braid", "ahoge", "hair_flower", "crown"),
    "outfit": ("dress", "skirt", "jacket", "uniform", "kimono", "cape", "boots", "gloves", "shirt", "pants"),
    "cute": ("smile", "chibi", "blush", "closed_mouth", "open_mouth"),
    "official": ("official_art", "character_sheet", "tachi-e"),
    "text_noise": ("speech_bubble", "text", "commentary", "translation_request"),
    "sensitive": ("large_breasts", "cleavage", "bikini", "swimsuit", "covered_nipples"),
    "male": ("1boy", "male_focus"),
}
KEY_TAGS = ("full_body", "looking_at_viewer", "facing_viewer", "front_view", "from_front", "standing", "sitting", "multiple_views", "turnaround", "character_sheet", "official_art", "transparent_background", "simple_background", "weapon", "armor", "wings", "tail", "horns", "animal_ears", "hat", "hair_ornament", "twintails", "ponytail", "braid", "dress", "uniform", "jacket", "1boy", "1girl")

# Tags of the rejection cascade.
SHEET_TAGS = ("character_sheet", "reference_sheet", "turnaround", "model_sheet")
REQUIRED_TAGS = ("multiple_views", "solo")
SUBJECT_TAGS = ("1girl", "1boy")
GROUP_TAGS = ("2girls", "2boys", "1girl_1boy", "duo", "trio", "group")
NEGATIVE_TAGS = ("anthro", "chibi", "comic", "creature", "furry", "greyscale", "grayscale", "lineart", "monochrome", "monster", "monster_boy", "monster_girl", "photo", "photorealistic", "realistic", "rough_sketch", "sketch", "traditional_media", "western", "star_wars", "marvel", "dc_comics", "superhero")
SIGNATURE_FEATURES = ("animal_ears", "cat_ears", "dog_ears", "fox_ears", "wolf_ears", "bunny_ears", "tail", "animal_tail", "cat_tail", "fox_tail", "wolf_tail", "horns", "wings", "pointy_ears", "elf", "elf_(dnd)", "demon_girl", "dragon_girl", "kemonomimi_mode")
NON_HUMAN_TAGS = ("centaur", "fish_girl", "mermaid")
PARTIAL_VIEW_TAGS = ("upper_body", "cowboy_shot", "portrait", "head_focus", "head_shot", "headshot", "close-up", "close_up", "bust")
GENERIC_TAGS = (*SHEET_TAGS, *REQUIRED_TAGS, *SUBJECT_TAGS, "full_body", "official_art", "profile", "from_side", "from_behind", "from_above", "from_below", "simple_background", "white_background", "highres", "absurdres", "standing", "sitting", "kneeling", "crouching", "looking_at_viewer", "facing_viewer", "smile")
COMMON_TRAITS = ("ahoge", "bangs", "bare_shoulders", "blush", "boots", "bow", "breasts", "cape", "closed_eyes", "closed_mouth", "collarbone", "dress", "earrings", "eyebrows_visible_through_hair", "female", "flower", "frills", "glasses", "gloves", "hair_between_eyes", "hair_ornament", "hat", "high_heels", "holding", "jacket", "jewelry", "long_hair", "long_sleeves", "medium_breasts", "medium_hair", "open_mouth", "pants", "ribbon", "shirt", "shoes", "short_hair", "short_sleeves", "skirt", "socks", "solo", "standing_on_one_leg", "swept_bangs", "thigh-highs", "translation_request", "very_long_hair")
VISUAL_SUFFIXES = ("_hair", "_eyes", "_dress", "_shirt", "_skirt", "_sleeves", "_sleeve", "_gloves", "_boots", "_shoes", "_legwear", "_background", "_hat", "_ribbon", "_bow", "_jacket", "_kimono", "_mouth", "_footwear")
SERIES_TAGS = ("fate_(series)", "fate/grand_order", "mahou_shoujo_madoka_magica", "kimetsu_no_yaiba", "sword_art_online", "lycoris_recoil", "bocchi_the_rock!")
MIN_PIXELS = 450

# Prefixes of rule ids.
HEAD_PREFIXES = ("hair_", "eye_", "glasses_", "headwear_", "headband_", "head_accessory", "head_ribbon", "horn_", "bangs_", "mouth_", "ponytail_", "head_")
HEAD_IDS = ("expression", "skin_tone", "skin_color", "has_ahoge", "has_wink", "has_bangs", "has_pointed_ears", "has_ponytail", "hair_over_eye", "has_hair_between_eyes")
HEAD_PARTS = ("hair_ribbon", "hair_ornament", "hair_accessory")
BODY_PREFIXES = ("top_", "bottom_", "dress_", "skirt_", "pants_", "sleeve_", "collar_", "legwear_", "footwear_", "shoe_", "shoes_", "boot_", "glove_", "belt_", "choker_", "necklace_", "bracelet_", "wrist_", "ankle_", "bag_", "weapon_", "wing_", "tail_", "handheld_", "holding_", "body_", "clothing_", "outfit_", "upper_", "lower_", "sash_", "cape_", "armor_", "jacket_", "coat_")
BODY_IDS = ("gender", "has_bag", "has_weapon", "has_wings")
IDENTITY_PREFIXES = ("hair_", "eye_", "headwear_", "head_accessory", "horn_", "mouth_", "expression", "top_", "bottom_", "dress_", "skirt_", "pants_", "coat_", "jacket_", "outfit_", "footwear_")
REJECTION_MARKERS = ("datainspectionfailed", "content", "policy", "safety", "sensitive", "forbidden", "审核", "敏感", "违规", "拒绝")

# Fidelity score.
ELEMENT_FACTORS = {"preserved": 1.0, "partial": 0.5, "missing": 0.0, "contradicted": 0.0, "unverifiable": None}
SPEC_POINTS = {"front_view": 5.0, "full_body": 4.0, "single_subject": 3.0, "white_background": 2.0, "three_dimensional": 4.0, "no_extra_text_or_watermark": 2.0}
CRITICAL_SPECS = ("front_view", "full_body", "single_subject", "three_dimensional")
HALLUCINATION_PENALTIES = {"minor": 2.0, "major": 8.0, "critical": 20.0}
