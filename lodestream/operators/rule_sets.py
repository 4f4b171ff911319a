"""Rule sets for showroom dialogues in Chinese, with the brand as a parameter."""

from __future__ import annotations

from lodestream.operators.rules import Rule

# Patterns of the stages of a visit, in order. {brand} stands for the brand's name,
# {models} for an alternation of model names.
STAGE_PATTERNS = {
    "greeting": (
        "欢迎.*{brand}", "{brand}.*欢迎", "您好.*{brand}", "第一次.*来", "首次.*来", "来.*店.*吗", "用户主理人", "请问.*怎么称呼",
        "怎么称呼.*您", "我是.*导购|我是.*AI|我是.*小特", "你好.*小特",
    ),
    "interest_probe": (
        "随便.*看看", "(已经|比较).*有.*意向", "打算.*买", "有.*换车.*计划", "来.*了解.*一下", "今天.*主要.*想", "(感兴趣|关注).*哪.*车",
        "想看.*哪.*车", "看.*什么.*车", "对.*车.*感兴趣", "来.*看.*轿车|来.*看.*SUV", "纯电.*还是.*增程|增程.*还是.*纯电",
        "(首次|第一次).*(购车|买车)", "(购车|买车).*意向", "只是.*逛逛",
    ),
    "needs_analysis": (
        "家人.*开", "自己.*开", "用车.*场景", "主要.*用途", "平时.*用车", "用车.*主要", "预算.*多少", "预算.*区间", "多少.*预算", "谁.*决策",
        "谁.*开", "换车.*原因", "旧车.*置换", "城市.*通勤", "长途.*出行", "接送.*家人", "后排.*乘客", "几口人", "最关心.*(续航|空间|安全|智能|舒适|价格)",
    ),
    "vehicle_selection": (
        "推荐.*车型", "适合.*车型", "适合.*版本", "哪款.*适合", "哪一款.*适合", "版本.*怎么选", "配置.*怎么选", "帮.*选.*车", "根据.*需求.*推荐",
        "家用.*推荐", "通勤.*推荐", "长途.*推荐", "纯电.*增程.*怎么选", "增程.*纯电.*怎么选", "选.*纯电.*还是.*增程", "({models}).*(怎么样|适合|推荐|对比)",
        "(给我)?推荐一下", "帮我推荐", "拿不准",
    ),
    "product_presentation": (
        "六方位", "绕车", "(带您|帮您|我来|给您).*(介绍|讲|看|展示)", "(介绍|讲解|展示|看看).*(外观|内饰|座舱|空间|底盘|配置|动力)",
        "(外观|内饰|座舱|空间|底盘).*(介绍|讲解|展示|看看|怎么样)", "核心.*卖点|主要.*亮点", "零重力.*座椅|贵妃椅", "灵蜥.*底盘", "前双叉臂|后轮转向",
        "激光雷达.*(位置|几个|哪里)", "(智驾|智能驾驶|辅助驾驶).*(怎么|介绍|讲|体验)",
    ),
    "test_drive": (
        "试驾", "试乘", "开一开", "体验.*驾驶", "亲自.*开", "上路.*感受", "安排.*试驾", "试驾.*路线", "试驾.*预约", "开下来.*感觉", "驾驶.*感受",
    ),
    "quote_negotiation": (
        "多少钱", "(整体|落地|裸车).*价", "落地价|裸车价", "报价", "有.*优惠", "权益.*怎么", "金融.*方案", "(贷款|按揭).*(怎么|多少|方案)", "月供.*多少",
        "首付.*多少", "利率.*多少", "置换.*价格", "补贴.*多少", "几折", "预算.*不够", "(觉得|感觉).*(贵|贵了)", "能.*优惠.*多少", "最低.*多少",
    ),
    "deal_confirmation": (
        "下订", "订车", "锁单", "交定金", "定金", "合同", "签约", "成交", "今天.*定", "现在.*定", "(有|查).*现车", "现车.*库存", "颜色.*选|选.*颜色",
        "配置.*确认|确认.*配置",
    ),
    "contact_retention": (
        "加.*微信", "留.*电话", "留.*联系方式", "联系方式.*留", "预约.*回访", "预约.*到店", "预约.*再来", "再来.*看看", "下次.*来", "感谢.*到访",
        "欢迎.*再次.*来", "关注.*小程序", "扫.*二维码", "有问题.*联系.*我",
    ),
}

# Topics a visitor may ask about, in order, with titles and patterns.
TOPIC_PATTERNS = {
    "chassis": ("底盘", ("底盘", "悬架", "减震", "后轮转向", "转弯半径", "灵蜥")),
    "exterior": ("外饰", ("外饰", "外观", "车漆", "车身颜色", "轮毂", "大灯", "灯组")),
    "interior": ("内饰", ("内饰", "座舱", "中控", "屏幕", "座椅", "零重力", "贵妃椅", "氛围灯")),
    "trunk": ("后备箱", ("后备箱", "行李箱", "尾箱", "储物空间", "装载")),
    "color": ("颜色", ("颜色", "配色", "车色", "内饰色", "什么色")),
    "adas": ("智驾", ("智驾", "智能驾驶", "辅助驾驶", "自动驾驶", "激光雷达", "NOA", "高快", "城市领航", "泊车")),
    "handling": ("操控", ("操控", "驾驶感", "加速", "动力", "刹车", "转向手感", "开起来")),
    "price": ("价格", ("多少钱", "价格", "报价", "优惠", "权益", "落地价", "裸车价", "预算", "月供", "金融", "贷款")),
    "range": ("续航", ("续航", "里程", "补能", "充电", "增程", "纯电续航", "亏电油耗")),
    "space": ("空间", ("空间", "后排", "腿部空间", "乘坐", "几个人坐", "家用空间")),
    "safety": ("安全", ("安全", "气囊", "碰撞", "电池安全", "防侧翻")),
    "comfort": ("舒适", ("舒适", "隔音", "静音", "冰箱", "空调", "通风", "加热", "按摩")),
    "config": ("配置", ("配置", "版本", "哪款", "顶配", "标配", "选装")),
    "test_drive": ("试驾", ("试驾", "试乘", "开一开", "预约试驾")),
    "delivery": ("交付", ("交付", "交车", "提车", "多久到", "排产", "现车", "库存")),
}


def stage_rules(brand: str, models: tuple[str, ...]) -> list[Rule]:
    named = "|".join(m.upper() for m in models) or "(?!)"
    return [Rule(k, tuple(p.replace("{brand}", brand).replace("{models}", named) for p in ps)) for k, ps in STAGE_PATTERNS.items()]


def topic_rules() -> list[Rule]:
    return [Rule(k, patterns, title=title) for k, (title, patterns) in TOPIC_PATTERNS.items()]
