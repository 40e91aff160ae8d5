"""Texts, word lists and formats that results must carry exactly. Plain data, no logic."""

# Columns of the cleaned table, in order.
CLEAN_COLUMNS = ["date", "school_name", "meal_type", "dishes", "menu_text", "allergy_codes", "calories", "carbs_g", "protein_g", "fat_g", "dish_count"]

# Menu classes and their keywords, in order.
MENU_TYPES = {
    "밥": ["밥", "덮밥", "볶음밥", "비빔밥", "주먹밥"],
    "면": ["면", "국수", "우동", "라면", "스파게티", "파스타", "쫄면"],
    "국물": ["국", "탕", "찌개", "전골", "스프", "짬뽕"],
    "튀김": ["튀김", "돈까스", "커틀릿", "치킨", "꼬치"],
    "디저트": ["푸딩", "케이크", "과일", "바나나", "주스", "요구르트", "아이스", "우유"],
}

# Keywords of the spice levels; a text with none has level 2.
SPICE = {5: ["불닭", "마라", "매운", "핵", "아주매운"], 4: ["짬뽕", "떡볶이", "고추", "낙지볶음"], 3: ["김치", "제육", "비빔", "고추장"]}

# Labels of nutrients in the raw text.
NUTRIENTS = {"carbs_g": "탄수화물", "protein_g": "단백질", "fat_g": "지방"}

# Names of clusters.
TOO_FEW, MIDDLE, LIGHT, HEARTY = "데이터 부족", "중간 구성", "상대적 가벼운 구성", "상대적 든든한 구성"

# Texts of the report.
SAFETY_NOTICE = "추천 결과는 취향 비교용입니다. 실제 식단과 알레르기 정보는 학교 급식표와 영양사 안내를 다시 확인하세요."
RESULT_COLUMNS = ["순위", "날짜", "추천 점수", "메뉴", "추천 이유", "식단 군집", "알레르기 번호"]
NO_CODES = "없음"
REASONS = {"similarity": "텍스트 유사도 ", "likes": "좋아하는 키워드: ", "types": "선호 유형: ", "avoids": "피하고 싶은 키워드: ", "spice": "매운맛 차이 "}
SUMMARY = "취향을 비교해 {shown}개 메뉴를 추천했습니다. 알레르기 주의 번호로 제외된 메뉴는 {excluded}개입니다.\n\n{notice}"
ALL_EXCLUDED = "선택한 알레르기 주의 번호 때문에 모든 메뉴가 제외되었습니다. 제외된 메뉴: {excluded}개\n\n{notice}"
FALLBACK_SCHOOL = "남악고등학교"
SAMPLE_LABEL = "급식 예비 데이터"
LIVE_LABEL, FALLBACK_LABEL = "실시간 데이터 사용", "예비 데이터 사용 · 실시간 조회 사유: {reason}"
NO_PERIOD = "확인할 수 없음"
LUNCH = "중식"

# Weights of the score.
BASE, BY_SIMILARITY, BY_LIKE, BY_TYPE, BY_AVOID, BY_SPICE = 20.0, 70.0, 8.0, 5.0, 18.0, 3.0
