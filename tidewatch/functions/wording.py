"""Texts of our own for evidence, strategies and drafts. Output is Turkish.

Marks in braces are filled in by the operators that use a text.
"""

from __future__ import annotations

NOT_MEASURED = "ölçülemedi"

# How the reader of a draft is addressed, next to the token.
READER_ROLE = "yöneticisi"

EVIDENCE = {
    "CHURN_RISK": (
        "{customer}: sipariş miktarındaki düşüş (%) son iki dönemde {two}, tek dönemde {single}."
    ),
    "MARGIN_RISK": (
        "{customer}: güncel brüt marj (%) {margin}; maliyet artışının fiyat artışından farkı (puan) {gap}."
    ),
    "BOTH": (
        "{customer}: sipariş miktarındaki düşüş (%) son iki dönemde {two}, tek dönemde {single}; "
        "güncel brüt marj (%) {margin}; maliyet artışının fiyat artışından farkı (puan) {gap}."
    ),
}

# One recommendation per risk type; for both risks margin comes first.
PLAYBOOK = {
    "CHURN_RISK": {
        "title": "Müşteriyi yeniden kazanma planı",
        "rationale": (
            "Sipariş hacmi hızla azalıyor; düzenli temas ve somut bir teklif alışkanlığı geri getirir. "
            "Dayanak: {evidence}"
        ),
        "steps": [
            "{customer} için sorumlu bir müşteri temsilcisi atayın ve üç iş günü içinde arayın.",
            "Siparişlerin neden azaldığını on beş dakikalık bir geri kazanım görüşmesinde öğrenin.",
            "Önümüzdeki iki sipariş için hacme bağlı sadakat indirimi önerin.",
            "Ödeme vadesini bir dönem için esnetmeyi teklif edin.",
            "Sonraki dönem miktarını bugünkü düzeyle karşılaştırıp sonucu kaydedin.",
        ],
    },
    "MARGIN_RISK": {
        "title": "Marjı toparlama planı",
        "rationale": (
            "Maliyetler satış fiyatından hızlı yükseliyor; fiyat ve ürün karması birlikte ele alınmalı. "
            "Dayanak: {evidence}"
        ),
        "steps": [
            "{customer} hesabında satılan her ürünün birim maliyetini güncelleyin.",
            "Yeni maliyete göre fiyat artışı teklifini on gün içinde sunun.",
            "Tedarikçiyle maliyet indirimi için görüşme planlayın.",
            "Müşteriye daha yüksek marjlı eşdeğer ürünleri tanıtın ve vadeyi kısaltın.",
        ],
    },
    "BOTH": {
        "title": "Önce marj, sonra hacim kurtarma planı",
        "rationale": (
            "Hem kârlılık hem sipariş hacmi geriliyor; önce zarar eden satış durdurulmalı, "
            "ardından hacim geri kazanılmalı. Dayanak: {evidence}"
        ),
        "steps": [
            "{customer} hesabında taban marjın altındaki ürünlerin fiyatını bu hafta düzeltin.",
            "Tedarikçiyle maliyeti düşürecek toplu alım koşullarını konuşun.",
            "Üst düzey bir yöneticiyle yüz yüze görüşme ayarlayın.",
            "Marjı koruyan ürünlerde geri dönüş indirimi önerin.",
            "Marj ve sipariş miktarını bir dönem boyunca her hafta izleyin.",
        ],
    },
}

SUBJECTS = {
    "CHURN_RISK": "İş birliğimizi birlikte güçlendirelim",
    "MARGIN_RISK": "Fiyat ve ürün koşullarımızı birlikte gözden geçirelim",
    "BOTH": "Ortak çalışma planımız için görüşme önerisi",
}

_EMAIL_OPENING = (
    "Sayın [{customer} {role}],\n\n"
    "Öncelikle bugüne kadar bize gösterdiğiniz güven için içtenlikle teşekkür ederiz. "
    "Sizinle kurduğumuz iş ilişkisi bizim için yalnızca bir satış kaydı değil, karşılıklı emekle "
    "büyüyen uzun soluklu bir ortaklıktır. Bu nedenle hesabınızı düzenli olarak inceliyor, "
    "ihtiyaçlarınıza zamanında yanıt verip vermediğimizi kendimize sık sık soruyoruz.\n\n"
)
_EMAIL_CLOSING = (
    "\n\nBu konuları konuşmak üzere önümüzdeki hafta size uygun bir gün ve saatte kısa bir görüşme "
    "yapmayı çok isteriz. Görüşmeyi telefonla, çevrim içi ya da ofisinizde gerçekleştirebiliriz. "
    "Size en uygun zamanı bu iletiye yanıt vererek bildirmeniz yeterlidir; hazırlıkları biz "
    "üstleneceğiz. Görüşmeden önce gündeme eklememizi istediğiniz bir başlık varsa lütfen paylaşın. "
    "Sorularınız için ekibimiz her zaman yanınızdadır.\n\n"
    "Değerli iş birliğiniz için yeniden teşekkür eder, sağlıklı ve bereketli günler dileriz.\n\n"
    "Saygılarımızla,\nSatış Ekibi"
)

_EMAIL_MIDDLE = {
    "CHURN_RISK": (
        "Son dönemde sipariş temponuzun önceki dönemlere göre yavaşladığını fark ettik. Bunun "
        "arkasında stok durumunuz, mevsimsel etkenler ya da hizmetimizde iyileştirmemiz gereken bir "
        "nokta olabilir. Görüşünüzü doğrudan sizden duymak isteriz. Size özel bir müşteri temsilcisi "
        "görevlendirdik; ayrıca önümüzdeki iki siparişiniz için hacme bağlı bir sadakat indirimi ve "
        "ödeme vadesinde esneklik hazırladık. Böylece planlarınızı daha rahat yapabileceğinize "
        "ve ihtiyaç duyduğunuz ürünlere zamanında ulaşabileceğinize inanıyoruz."
    ),
    "MARGIN_RISK": (
        "Geçtiğimiz dönemlerde ham madde, enerji ve lojistik giderleri belirgin biçimde arttı. Bu "
        "artışı bugüne kadar mümkün olduğunca size yansıtmamaya çalıştık. Hizmet kalitemizi ve teslim "
        "sürelerimizi koruyabilmek için fiyatlarımızı, ürün seçeneklerinizi ve ödeme koşullarını "
        "birlikte gözden geçirmemiz gerekiyor. Bütçenizi zorlamayacak eşdeğer ürünler, toplu alım "
        "seçenekleri ve kademeli bir geçiş takvimi hazırladık. Amacımız iki taraf için de "
        "sürdürülebilir ve açık koşullarda ilerlemektir."
    ),
    "BOTH": (
        "Son dönemde hem sipariş temponuzun yavaşladığını hem de artan maliyetlerin ortak "
        "çalışmamızı zorladığını görüyoruz. Bu iki konuyu ayrı ayrı değil, tek bir plan içinde ele "
        "almak istiyoruz. Önce ürün ve fiyat koşullarını birlikte gözden geçirmeyi, ardından geri "
        "dönüş indirimleri ve öncelikli teslimat ile siparişlerinizi kolaylaştırmayı öneriyoruz. "
        "Üst yönetimimizden bir arkadaşımız bu süreci sizin için bizzat takip edecek. Böylece "
        "kararları hızlı alabileceğimize ve ortaklığımızı sağlam bir zemine taşıyacağımıza inanıyoruz."
    ),
}

EMAIL_BODIES = {
    risk: _EMAIL_OPENING + middle + _EMAIL_CLOSING for risk, middle in _EMAIL_MIDDLE.items()
}

_CHAT_OPENING = (
    "Merhaba [{customer} {role}], umarız her şey yolundadır. Bizimle çalıştığınız için çok teşekkür ederiz. "
)
_CHAT_CLOSING = (
    " Bu hafta on beş dakikalık kısa bir telefon görüşmesi yapabilir miyiz? Size uygun gün ve saati buradan "
    "yazmanız yeterli, biz sizi hemen ararız. Aklınıza takılan her soru için de bize bu hattan "
    "dilediğiniz zaman ulaşabilirsiniz. İyi çalışmalar, bol kazançlar dileriz."
)

CHAT_BODIES = {
    "CHURN_RISK": _CHAT_OPENING
    + (
        "Son dönemde siparişlerinizin azaldığını fark ettik ve nedenini sizden duymak istedik. Size özel "
        "sadakat indirimi ile ödeme vadesinde esneklik hazırladık."
    )
    + _CHAT_CLOSING,
    "MARGIN_RISK": _CHAT_OPENING
    + (
        "Artan maliyetler nedeniyle fiyat ve ürün koşullarımızı sizinle birlikte gözden geçirmek "
        "istiyoruz. Bütçenizi koruyacak eşdeğer ürünler ve toplu alım seçenekleri hazırladık."
    )
    + _CHAT_CLOSING,
    "BOTH": _CHAT_OPENING
    + (
        "Siparişlerinizin yavaşladığını ve maliyetlerin arttığını görüyoruz. Koşulları birlikte "
        "düzenlemek ve size geri dönüş indirimi sunmak için ortak bir plan hazırladık."
    )
    + _CHAT_CLOSING,
}

# Accepted number of words per channel.
WORD_LIMITS = {"EMAIL": (150, 250), "WHATSAPP": (60, 100)}

ANALYSIS_SUMMARY = (
    "{total} müşteri riskli bulundu: {churn} kayıp riski, {margin} marj baskısı, {both} her ikisi; "
    "{critical} bulgu kritik düzeyde."
)
NO_ANALYSIS_SUMMARY = "Riskli müşteri bulunmadı."
STRATEGY_SUMMARY = "{total} öneri hazırlandı; {urgent} tanesi acil öncelikli."
