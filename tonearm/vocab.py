"""Names, rule tables and weights that results depend on.

Everything in this module is a fixed value: a column name, a label, a needle or a number that must
be exactly this for results to come out right. There is no logic here.
"""

from __future__ import annotations

# --- Fixed values: catalogue columns -------------------------------------------------------------

BASE_COLUMNS = """
source_file song_id name aliases translations artist_names artist_ids album_id album_name
album_pic_url duration_ms duration_seconds duration_text publish_time_ms publish_date disc track_no
popularity mv_id fee copyright status version collected_at check_success check_message playable
max_br_level max_bitrate play_max_br_level play_max_bitrate download_max_br_level
download_max_bitrate free_level paid privilege_fee privilege_status comment_total
hot_comment_count first_hot_comment_user first_hot_comment_likes first_hot_comment
first_comment_user first_comment_likes first_comment has_lyric lyric_line_count lyric_excerpt
has_translation translation_excerpt has_romaji romaji_excerpt similar_song_ids similar_song_names
similar_artist_names wiki_summary_excerpt
""".split()
QUALITY_LEVELS = ("l", "m", "h", "sq", "hr")
QUALITY_FIELDS = ("br", "size", "sr")
URL_LEVELS = ("standard", "exhigh", "lossless", "hires")
URL_FIELDS = ("url", "br", "size", "type", "code", "md5")
LYRIC_COLUMNS = ["lyric_text", "translation_text", "romaji_text"]

QUALITY_COLUMNS = [f"{level}_{field}" for level in QUALITY_LEVELS for field in QUALITY_FIELDS]
URL_COLUMNS = [f"{level}_{field}" for level in URL_LEVELS for field in URL_FIELDS]

GENERATED_TAG_COLUMNS = """
generated_language_tags style_tags emotion_tags theme_tags scene_tags audio_tags
lyric_semantic_tags comment_semantic_tags all_tags tag_confidence tag_sources bpm
local_audio_path local_audio_title local_audio_artist local_audio_album local_duration_seconds
duration_diff_seconds audio_match_score audio_match_reason match_source audio_duration_seconds
audio_sample_rate audio_tempo_bpm audio_tempo_raw_bpm audio_tempo_source audio_onset_strength
audio_rms audio_zcr audio_centroid_hz audio_crest audio_feature_tags audio_error
audio_vocal_band_ratio source_separation_model source_separation_error source_drums_energy_ratio
source_bass_energy_ratio source_other_energy_ratio source_vocals_energy_ratio
source_vocal_energy_ratio source_instrumental_energy_ratio vocal_presence_score
instrumental_presence_score vocal_instrumental_tags lyric_semantic_scores lyric_semantic_model
lyric_semantic_error comment_semantic_scores comment_semantic_model comment_semantic_error
mert_cluster mert_neighbor_song_ids mert_neighbor_scores mert_emotion_tags mert_emotion_scores
mert_valence mert_arousal mert_embedding_path mert_error mert_chunks mert_embedding_dim mert_layer
""".split()

TEXT_COLUMNS = """
name aliases translations artist_names album_name lyric_excerpt translation_excerpt romaji_excerpt
similar_song_names similar_artist_names wiki_summary_excerpt first_hot_comment first_comment
style_tags emotion_tags theme_tags scene_tags audio_tags lyric_semantic_tags all_tags
""".split()

NUMERIC_COLUMNS = """
duration_seconds popularity comment_total hot_comment_count lyric_line_count standard_br exhigh_br
lossless_br hires_br
""".split()
BOOLEAN_COLUMNS = ["playable", "has_lyric", "has_translation", "has_romaji", "check_success"]

# --- Fixed values: labels -------------------------------------------------------------------------

LANGUAGE_TAGS = ["国语", "粤语", "英语", "日语", "韩语", "纯音乐", "华语", "欧美"]
CHINESE_LANGUAGES = ["国语", "粤语", "华语"]
JAPANESE_LANGUAGE = "日语"
ENGLISH_LANGUAGE = "英语"
UNKNOWN = "未知"
QUALITY_LABELS = [("hires", "Hi-Res"), ("lossless", "无损"), ("exhigh", "极高"), ("standard", "标准")]
HIGH_QUALITY = ["Hi-Res", "无损"]
LOCAL_AUDIO_TAG = "本地音频"
INSTRUMENTAL_TAG = "纯音乐"
INSTRUMENTAL_PLACEHOLDER = "纯音乐，请欣赏"
INSTRUMENTAL_HINTS = ["纯音乐", "轻音乐", "钢琴", "管弦", "古典"]
RELAX_TAG = "放松"
FAST, MEDIUM, SLOW = "快节奏", "中速", "慢节奏"
DECADE_SUFFIX = "年代"
VOCAL_STRONG, INSTRUMENT_STRONG, VOCAL_BALANCED = "人声强", "器乐强", "人声/器乐均衡"
UNLICENSED_MARKER = "暂无版权"

# --- Fixed values: tag rules (tag, needles), in rule order ----------------------------------------

STYLE_RULES = [
    ("华语流行", ["流行-华语流行", "华语流行"]),
    ("粤语流行", ["流行-粤语流行", "粤语流行"]),
    ("欧美流行", ["流行-欧美流行", "欧美流行"]),
    ("日语流行", ["流行-日语流行", "日语流行", "J-Pop", "JPOP"]),
    ("韩语流行", ["流行-韩语流行", "韩语流行", "K-Pop", "KPOP"]),
    ("轻音乐", ["轻音乐", "New Age", "新世纪"]),
    ("纯音乐", ["纯音乐，请欣赏", "纯音乐"]),
    ("钢琴", ["钢琴", "Piano", "piano"]),
    ("管弦", ["管弦", "交响", "Orchestra", "orchestra", "Philharmonic"]),
    ("电子", ["电子", "EDM", "Future Bass", "House", "Trance"]),
    ("摇滚", ["摇滚", "Rock", "rock"]),
    ("民谣", ["民谣", "Folk", "folk"]),
    ("古风", ["古风", "国风"]),
    ("说唱", ["说唱", "Hip-Hop", "Rap", "rap"]),
    ("R&B", ["R&B", "节奏布鲁斯"]),
    ("爵士", ["爵士", "Jazz", "jazz"]),
    ("古典", ["古典", "Classical", "classical"]),
    ("游戏音乐", ["游戏原声", "游戏音乐", "HOYO-MiX", "原神", "崩坏", "鸣潮"]),
    ("影视原声", ["影视原声", "电视剧原声", "电影原声", "主题曲", "插曲", "片尾曲", "片头曲", "OST"]),
]
EMOTION_RULES = [
    ("治愈", ["治愈", "温暖", "暖暖", "安心", "疗愈"]),
    ("欢快", ["欢快", "快乐", "开心", "明亮", "阳光", "活力"]),
    ("悲伤", ["悲伤", "忧伤", "难过", "心酸", "眼泪", "流泪", "哭", "遗憾"]),
    ("怀旧", ["怀旧", "回忆", "青春", "童年", "光阴", "旧时光", "经典老歌"]),
    ("热血", ["热血", "励志", "燃", "加油", "坚持", "不应舍弃", "命运"]),
    ("宁静", ["宁静", "安静", "平静", "舒缓", "放松", "夜的钢琴曲"]),
    ("孤独", ["孤独", "孤单", "寂寞", "一个人"]),
    ("浪漫", ["浪漫", "爱", "陪伴", "想你", "温柔"]),
    ("史诗", ["史诗", "宏大", "壮阔", "苍茫", "英雄", "战争"]),
    ("神秘", ["神秘", "梦境", "幻想", "奇幻"]),
]
EXPLICIT_EMOTIONS = {
    "治愈": "治愈", "悲伤": "悲伤", "欢快": "欢快", "活力": "欢快", "热血励志": "热血",
    "自信": "热血", "宁静": "宁静",
}
EXPLICIT_THEMES = {"思念": "思念"}
THEME_RULES = [
    ("爱情", ["爱情", "爱你", "爱意", "恋人", "喜欢你", "陪伴你", "想你"]),
    ("离别", ["离别", "分别", "再见", "离开", "失去", "告别"]),
    ("成长", ["成长", "青春", "少年", "人生", "长大"]),
    ("时光", ["时光", "光阴", "岁月", "昨天", "从前", "回忆"]),
    ("江湖", ["江湖", "恩义", "射雕", "天边", "风沙", "侠"]),
    ("旅途", ["旅途", "旅行", "远方", "路程", "流浪", "风景"]),
    ("梦想", ["梦想", "梦", "希望", "未来", "坚持"]),
    ("思念", ["思念", "想念", "想你", "挂念"]),
    ("自然", ["春天", "秋天", "冬天", "夏日", "大海", "海边", "星空", "森林", "花海", "雨中"]),
]
SCENE_RULES = [
    ("学习", ["学习", "自习", "专注"]),
    ("睡前", ["睡前", "入眠", "晚安", "摇篮曲"]),
    ("工作", ["工作", "办公", "专注"]),
    ("通勤", ["通勤", "开车", "车上"]),
    ("运动", ["运动", "跑步", "健身"]),
    ("KTV", ["KTV", "卡拉OK"]),
    ("回忆杀", ["回忆杀", "童年", "青春", "经典老歌"]),
    ("放松", ["放松", "舒缓", "治愈", "轻音乐"]),
    ("燃向", ["热血", "励志", "燃", "史诗"]),
]
COMMENT_RULES = [
    ("回忆共鸣", ["回忆", "童年", "青春", "小时候", "以前", "当年", "那年", "怀念", "泪目"]),
    ("治愈共鸣", ["治愈", "温暖", "安心", "舒服", "放松", "平静", "温柔"]),
    ("悲伤共鸣", ["流泪", "哭", "泪", "难过", "心酸", "遗憾", "破防", "emo"]),
    ("热血共鸣", ["燃", "热血", "励志", "加油", "力量", "勇气", "坚持"]),
    ("好听认可", ["好听", "神曲", "封神", "循环", "单曲循环", "喜欢", "爱了", "绝了"]),
    ("故事感", ["故事", "人生", "经历", "后来", "想起", "陪伴", "告别"]),
    ("幽默吐槽", ["哈哈", "笑死", "蚌埠", "绷不住", "草", "233", "hhhh"]),
    ("亲情陪伴", ["爸爸", "妈妈", "父亲", "母亲", "家人", "爸妈", "爷爷", "奶奶"]),
    ("影视回忆", ["电视剧", "电影", "动漫", "片头", "片尾", "主题曲", "插曲"]),
]
LYRIC_SEMANTIC_RULES = [
    ("爱情思念", ["爱", "想你", "思念", "拥抱", "心动", "恋人", "等待", "重逢"]),
    ("离别遗憾", ["离别", "再见", "告别", "遗憾", "错过", "眼泪", "远走", "分开"]),
    ("成长追寻", ["成长", "梦想", "远方", "寻找", "奔跑", "未来", "答案", "旅程"]),
    ("孤独夜晚", ["孤独", "寂寞", "夜", "月光", "一个人", "沉默", "失眠", "黑暗"]),
    ("治愈温柔", ["温柔", "治愈", "安静", "微风", "阳光", "陪伴", "安心", "平静"]),
    ("热血信念", ["热血", "勇气", "信念", "战斗", "燃烧", "坚持", "不放弃", "希望"]),
    ("怀旧时光", ["回忆", "青春", "童年", "从前", "时光", "旧梦", "昨日", "怀念"]),
    ("城市旅途", ["城市", "街道", "车站", "旅途", "海边", "路上", "远行", "风景"]),
    ("自然意象", ["天空", "大海", "星星", "雨", "风", "花", "雪", "山川"]),
    ("梦境幻想", ["梦", "幻想", "童话", "奇迹", "魔法", "宇宙", "星河", "光"]),
    ("江湖古风", ["江湖", "山河", "刀剑", "红尘", "故人", "长安", "明月", "青丝"]),
    ("亲情陪伴", ["妈妈", "爸爸", "家", "故乡", "孩子", "亲人", "归来", "守候"]),
    ("纯音乐留白", ["纯音乐", "请欣赏", "无词", "instrumental", "piano", "钢琴"]),
]

# --- Fixed values: term extraction -----------------------------------------------------------------

STOP_WORDS = """
作词 作曲 编曲 制作人 演唱 歌词 纯音乐 请欣赏 欣赏 music lyrics composer arranger the and you that
this with for are was were your 我的 我们 你们 他们 一个 没有 什么 怎么 还是 只是 不要 不能 それ これ から
まで こと もの
""".split()

# --- Fixed values: scoring (feature, list column, part label, scale) -------------------------------

SCORED_FEATURES = [
    ("all_tags", "generated_tag_list", "综合标签", 0.45),
    ("language", "language_tags", "语种", 0.35),
    ("style", "style_tag_list", "风格", 0.55),
    ("emotion", "emotion_tag_list", "情绪", 0.65),
    ("theme", "theme_tag_list", "主题", 0.45),
    ("scene", "scene_tag_list", "场景", 0.45),
    ("audio", "audio_tag_list", "音频标签", 0.60),
    ("artists", "artist_list", "歌手", 0.85),
    ("title_terms", "title_terms", "歌名关键词", 0.55),
    ("lyric_terms", "lyric_terms", "歌词关键词", 0.50),
    ("lyric_semantic", "lyric_semantic_tags", "歌词语义", 0.65),
    ("comment_semantic", "comment_semantic_tags", "评论语义", 0.75),
]
# The first seven features share the single user map of tag weights.
TAG_WEIGHT_FEATURES = ["all_tags", "language", "style", "emotion", "theme", "scene", "audio"]
NUMERIC_PARTS = [
    ("热度", 35.0), ("歌词完整度", 24.0), ("音质", 18.0), ("可播放", 12.0), ("本地音频", 18.0),
    ("MERT", 14.0),
]
HISTORY_PART = "历史偏好"
INITIAL_TAG_WEIGHTS = {
    "人声强": 1.4, "器乐强": 1.25, "热血": 1.25, "治愈": 1.2, "宁静": 1.15, "纯音乐": 1.15, "悲伤": 0.8,
}
DEFAULT_DIMENSION_WEIGHTS = {
    "综合标签": 1.0, "语种": 0.5, "风格": 1.0, "情绪": 1.0, "主题": 0.8, "场景": 0.8, "音频标签": 1.0,
    "歌手": 1.0, "歌名关键词": 0.7, "歌词关键词": 0.8, "歌词语义": 0.8, "评论语义": 0.8, "热度": 0.8,
    "歌词完整度": 0.5, "音质": 0.5, "可播放": 0.6, "本地音频": 0.8, "MERT": 0.4,
}
SIMILARITY_TOP_K = 5000
PAGE_SIZE = 60
HISTORY_SIZE = 80

# --- Fixed values: emotion prototypes (label, valence, arousal, display tag) -----------------------

EMOTION_PROTOTYPES = [
    ("calm", 0.72, 0.22, "宁静"),
    ("happy", 0.82, 0.72, "欢快"),
    ("sad", 0.20, 0.25, "悲伤"),
    ("angry", 0.18, 0.82, "激烈"),
    ("romantic", 0.78, 0.40, "浪漫"),
    ("tense", 0.28, 0.68, "紧张"),
    ("energetic", 0.62, 0.88, "热血"),
    ("melancholic", 0.32, 0.38, "忧郁"),
]
